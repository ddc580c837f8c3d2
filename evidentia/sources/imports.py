"""Reading foreign tables: header aliases, value types, column mapping, social exports, registers, uploads."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names that mean the same column.
ALIASES = {
    "source": ("source", "caller", "from", "sender", "a_party"),
    "target": ("target", "callee", "to", "receiver", "b_party"),
    "relation": ("relation", "type", "relationship"),
    "event_time": ("date", "timestamp", "time", "datetime"),
    "amount": ("amount", "value", "sum"),
    "duration": ("duration", "duration_seconds", "seconds"),
    "confidence": ("confidence",),
}
SUFFIXES = (".txt", ".csv", ".json", ".pdf", ".docx", ".xlsx", ".png", ".jpg")
MAGIC = {".pdf": "25504446", ".png": "89504E47", ".docx": "504B0304", ".xlsx": "504B0304", ".jpg": "FFD8FF"}


def aliased(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The first non-empty of the columns whose header is an alias of name."""
    have = {c.strip().lower(): c for c in df.columns}
    found = [F.col(f"`{have[a]}`") for a in ALIASES[name] if a in have]
    blank = [F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in found]
    return (F.coalesce(*blank) if blank else F.lit(None)).try_cast(kind)


def relationships(df: DataFrame) -> DataFrame:
    """id, source, target, relation, event_time, amount, duration, confidence, event_type. Rows without both ends go."""
    out = df.select(
        aliased(df, "source").alias("source"), aliased(df, "target").alias("target"), F.regexp_replace(F.upper(F.coalesce(aliased(df, "relation"), F.lit("related to"))), " +", "_").alias("relation"),
        aliased(df, "event_time", "timestamp").alias("event_time"), aliased(df, "amount", "double").alias("amount"), aliased(df, "duration", "double").alias("duration"), F.coalesce(aliased(df, "confidence", "double"), F.lit(1.0)).alias("confidence"),
    ).where("source IS NOT NULL AND target IS NOT NULL")
    kind = F.when(F.col("amount").isNotNull(), "TRANSACTION").when(F.col("duration").isNotNull(), "COMMUNICATION").when(F.col("event_time").isNotNull(), "RELATIONSHIP_EVENT")
    return out.withColumn("event_type", kind).withColumn("id", F.sha1(F.concat_ws("|", "source", "target", "relation")))


def guess_type(v: Column) -> Column:
    t = F.trim(v)
    return (
        F.when(t.rlike(r"^[+]?[0-9][0-9 -]{8,14}$"), "PHONE").when(t.rlike(r"^[^@ ]+@[^@ ]+[.][a-z]+$"), "EMAIL").when(t.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}$"), "VEHICLE").when(t.rlike(r"^[0-9]{6,18}$"), "ACCOUNT").otherwise("ENTITY")
    )


def suggest_mapping(columns: list[str], wanted: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, tuple[str, float]]:
    """Column -> (field, confidence), one to one: equal names first, then contained ones, then similar ones."""
    plain = lambda s: re.sub(r"[^a-z0-9]+", "_", s.lower()).strip("_")
    scored = []
    for c in columns:
        p = plain(c)
        for field, names in wanted.items():
            best = max((1.0 if p == a else 0.8 if len(a) >= 6 and a in p else 0.9 * r if (r := difflib.SequenceMatcher(None, p, a).ratio()) >= 0.84 else 0.0) for a in names)
            if best:
                scored.append((-best, c, field))
    out: dict[str, tuple[str, float]] = {}
    for best, c, field in sorted(scored):
        if c not in out and field not in {f for f, _ in out.values()}:
            out[c] = (field, round(-best, 3))
    return out


def valid_uploads(files: DataFrame, most: int = 25_000_000) -> DataFrame:
    """binaryFile rows with valid: known suffix, allowed size, first bytes that fit the suffix."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    fits = F.lit(True)
    for s, m in MAGIC.items():
        fits = F.when(suffix == s, head.startswith(m)).otherwise(fits)
    return files.withColumn("valid", suffix.isin(*SUFFIXES) & (F.col("length") > 0) & (F.col("length") <= most) & fits)


def social_posts(raw: DataFrame) -> DataFrame:
    """platform, handle, post_id, text, likes, is_repost from loosely named columns; rows without post and account go."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*[F.col(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string"))
    handle = F.lower(F.regexp_replace(F.regexp_replace(F.trim(pick("handle", "username", "user", "author")), r"^https?://[^/]+/", ""), r"^@|[/?].*$", ""))
    text = pick("text", "content", "message", "body")
    out = raw.select(F.lower(pick("platform", "network")).alias("platform"), handle.alias("handle"), pick("post_id", "id").alias("post_id"), text.alias("text"), count(pick("likes", "favorites", "favourites")).alias("likes"), F.coalesce(text.rlike(r"^RT @\w+"), F.lit(False)).alias("is_repost"))
    return out.where("coalesce(text, '') <> '' OR coalesce(handle, '') <> ''")


def count(v: Column) -> Column:
    """1.2k, 3m, 1,024 -> long."""
    t = F.lower(F.regexp_replace(v, "[, ]", ""))
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[kmb]?$", 1).try_cast("double")
    unit = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).when(t.endswith("b"), 1e9).otherwise(1.0)
    return F.round(n * unit).cast("long")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A register: all columns as text; a bad cell never fails the read."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', mode="PERMISSIVE")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, sha256 of text files."""
    f = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return f.select("path", F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def commit_new(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not known yet, once each, and the rejected rows with a reason."""
    named = rows.where(F.col(key).isNotNull() & (F.trim(key) != ""))
    fresh = named.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    nameless = rows.where(F.col(key).isNull() | (F.trim(key) == "")).withColumn("reason", F.lit("no number"))
    old = named.join(known.select(key), key, "left_semi").withColumn("reason", F.lit("known already"))
    return fresh, nameless.unionByName(old)


# Labels of the lines that a register's row becomes, and the fields they are taken from.
REPORT_LINES = (
    ("District", "district"), ("Police Station", "police_station"), ("Year", "year"), ("FIR No", "fir_number"), ("Date of FIR", "fir_date"), ("Acts & Sections", "sections"),
    ("Place of Occurrence", "place_of_occurrence"), ("Date of Occurrence", "occurrence_date"), ("Complainant / Informant:", ""), ("Name", "complainant"), ("Father's Name", "father_name"),
    ("Address", "complainant_address"), ("Accused", "accused"), ("Phone", "phones"), ("Vehicle used", "vehicles"), ("Account", "accounts"), ("Email", "emails"),
    ("Short Description of Incident", "description"), ("Investigating Officer", "investigating_officer"),
)
REPORT_HEAD = ("FIRST INFORMATION REPORT", "(structured-register import - awaiting human review)")
CELL = 500


def unique_headers(columns: list[str]) -> list[str]:
    """Trimmed names; the second of equal ones is called 'name (2)', and so on; empty ones 'column'."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        name = c.strip() or "column"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def register_documents(rows: DataFrame, mapping: dict[str, str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A register's rows as report texts that await review: number, text, sha256, fields (JSON); and number, reason of those left out.

    mapping: field -> column of rows; fir_number must be mapped. known: sha256 of texts that are there already. Rows of blanks
    are nothing. Of equal texts one is new, the others are known.
    """
    if "fir_number" not in mapping:
        raise ValueError("a column must be mapped to fir_number")
    cell = lambda c: F.left(F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\s+", " ")), F.lit(CELL))
    v = rows.select(*[cell(c).alias(f) for f, c in mapping.items()])
    v = v.where(F.concat(*[F.col(f) for f in mapping]) != "")
    person = [F.col(f) for f in ("complainant", "father_name", "complainant_address") if f in mapping]
    some = F.concat(*person) != "" if person else F.lit(False)
    line = lambda label, f: F.when(F.col(f) != "", F.concat(F.lit(f"{label}: "), F.col(f)))
    lines = [F.when(some, label) if not f else line(label, f) for label, f in REPORT_LINES if not f or f in mapping]
    text = F.concat(F.concat_ws("\n", *[F.lit(h) for h in REPORT_HEAD], *lines), F.lit("\n"))
    fields = F.to_json(F.struct(*[F.when(F.col(f) != "", F.col(f)).alias(f) for f in mapping]))
    d = v.select(F.col("fir_number").alias("number"), text.alias("text"), fields.alias("fields")).withColumn("sha256", F.sha2("text", 256))
    named = d.where("number <> ''")
    copies = named.groupBy("sha256").agg(F.count("*").alias("n"), F.first("number").alias("number"), F.first("text").alias("text"), F.min("fields").alias("fields"))
    copies = copies.join(known.select("sha256", F.lit(True).alias("old")).distinct(), "sha256", "left")
    extra = F.col("n") - F.when(F.col("old"), 0).otherwise(1)
    again = copies.where(extra > 0).select("number", F.explode(F.array_repeat(F.lit("known already"), extra.cast("int"))).alias("reason"))
    return copies.where("old IS NULL").select("number", "text", "sha256", "fields"), d.where("number = ''").select("number", F.lit("no number").alias("reason")).unionByName(again)
