"""Exports of a case: tables for CSV and JSON, calendars, redacted rows, indexes. Each gives a DataFrame; writers are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.integrity import keyed_hash

COLUMNS = ("section", "id", "name", "type", "relation", "source", "target", "status", "confidence", "source_ref", "event_time")


def case_table(entities: DataFrame, relationships: DataFrame, alerts: DataFrame) -> DataFrame:
    """All rows of a case in the eleven columns of its CSV; what a section lacks is null.

    entities: id, name, type, confidence. relationships: id, relation, source, target, status, confidence, source_ref,
    event_time. alerts: id, name, status, confidence.
    """
    parts = [df.select(F.lit(s).alias("section"), *[F.col(c).cast("string").alias(c) for c in df.columns if c in COLUMNS]) for s, df in (("entity", entities), ("relationship", relationships), ("alert", alerts))]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header. Cells that a spreadsheet would run as formulas get a quote in front."""
    safe = [F.when(F.col(c).cast("string").rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*safe).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(case: str, entities: DataFrame, relationships: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: the case's counts by kind as JSON."""
    count = lambda df, by, name: df.groupBy(by).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("kind"), "n"))).alias(name))
    j = count(entities, "type", "entities").crossJoin(count(relationships, "relation", "relationships")).crossJoin(count(alerts, "status", "alerts"))  # one row each
    return j.select(F.to_json(F.struct(F.lit(case).alias("case_number"), "entities", "relationships", "alerts")).alias("report"))


def _escaped(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for a, b in (("\\\\", "\\\\\\\\"), (";", "\\\\;"), (",", "\\\\,"), ("\r\n|\n|\r", "\\\\n")):
        t = F.regexp_replace(t, a, b)
    return t


def calendar_events(deadlines: DataFrame, producer: str = "evidentia") -> DataFrame:
    """id, ics: an all-day event with a reminder one day before. deadlines: id, case_number, label, note, due (date)."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:deadline-"), F.col("id").cast("string"), F.lit(f"@{producer}")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("due"))), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("due", 1))),
        F.concat(F.lit("SUMMARY:"), _escaped(F.concat(F.lit("["), F.col("case_number"), F.lit("] "), F.col("label")))), F.concat(F.lit("DESCRIPTION:"), _escaped(F.col("note"))), F.lit("TRANSP:TRANSPARENT"), F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"),
        F.concat(F.lit("DESCRIPTION:"), _escaped(F.col("label"))), F.lit("TRIGGER:-P1D"), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    ]
    return deadlines.select("id", F.concat_ws("\r\n", *[folded(x) for x in lines]).alias("ics"))


def folded(line: Column, width: int = 74) -> Column:
    """Lines of at most width bytes; what follows begins with a blank. Plain characters are counted as the bytes they are."""
    step = F.aggregate(
        F.filter(F.split(line, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda acc, c: F.when(acc["n"] + F.octet_length(c) > width, F.struct(F.concat(acc["out"], F.lit("\r\n "), c).alias("out"), (F.octet_length(c) + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), (acc["n"] + F.octet_length(c)).alias("n"))),
    )
    return step["out"]


def evidence_index(rows: DataFrame, custody: DataFrame) -> DataFrame:
    """no, id, name, sha256, and how often it was touched, by kind. rows: case_number, id, name, sha256. custody: id, action."""
    c = custody.groupBy("id").agg(F.count("*").alias("events"), F.count_if(F.col("action") == "verify").alias("verified"), F.count_if(F.col("action") == "export").alias("exported"))
    w = Window.partitionBy("case_number").orderBy("id")
    return rows.withColumn("no", F.row_number().over(w)).join(c, "id", "left").select("case_number", "no", "id", "name", "sha256", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("events", "verified", "exported")])


# Categories that are redacted, in the order of their priority, and their labels.
REDACTED = (("email", tx.EMAIL, "EMAIL"), ("ip", tx.IPV4, "ADDRESS"), ("phone", r"(?:\+91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}", "PHONE"))


def labels(docs: DataFrame, salt: bytes, text: str = "text") -> DataFrame:
    """kind, value, label: each value's number in the order of a keyed hash, so labels of two exports can't be joined.

    Numbers are given by hash ranges, whose sizes are added up first, so no task sorts all values.
    """
    parts = None
    for kind, pattern, prefix in REDACTED:
        v = docs.select(F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).alias("value"))
        parts = v if parts is None else parts.unionByName(v)
    v = parts.withColumn("value", F.lower("value")).distinct().withColumn("h", keyed_hash(salt, F.concat_ws("|", "kind", "value")))
    v = v.withColumn("range", F.substring("h", 1, 2))
    sizes = v.groupBy("kind", "range").agg(F.count("*").alias("n"))
    before = sizes.select("kind", "range", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("kind", "range").orderBy("h"))
    return v.withColumn("own", own).join(F.broadcast(before), ["kind", "range"]).select("kind", "value", F.format_string("%s-%03d", "prefix", F.col("before") + F.col("own")).alias("label"))  # 256 ranges a kind


def redacted(docs: DataFrame, salt: bytes, key: str = "doc_id", text: str = "text", mode: str = "pseudonymise") -> DataFrame:
    """key, text, replaced: the text with each value of the redacted kinds exchanged for its label, or for its kind in mode 'mask'.

    Labels are those of labels() with the same salt. A text's own values travel, never the text: a row meets the labels of the
    values it holds. Longer values go first, so no value is cut by one within it. Null texts stay null. Keys are unique.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("found"))
    each = F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), named(kind)) for kind, p, _ in REDACTED]))
    if mode == "mask":
        plain = docs.select(key, F.col(text).alias("text"), F.transform(each, lambda x: F.struct(x["found"].alias("found"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("label"))).alias("own"))
    else:
        values = docs.select(key, F.explode(each).alias("v")).select(key, "v.kind", "v.found", F.lower("v.found").alias("value"))
        own = values.join(labels(docs, salt, text), ["kind", "value"]).groupBy(key).agg(F.collect_list(F.struct("found", "label")).alias("own"))
        plain = docs.select(key, F.col(text).alias("text")).join(own, key, "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<found:string,label:string>>")))
    order = F.transform(F.array_sort(F.transform(F.col("own"), lambda x: F.struct((-F.length(x["found"])).alias("n"), x["found"].alias("found"), x["label"].alias("label")))), lambda x: F.struct(x["found"].alias("found"), x["label"].alias("label")))
    return plain.select(key, F.aggregate(order, F.col("text"), lambda acc, x: F.replace(acc, x["found"], x["label"])).alias("text"), F.size("own").alias("replaced"))


def masked_text(c: Column) -> Column:
    """The text with the kinds of what is redacted in place of the values."""
    for kind, p, _ in REDACTED:
        c = F.regexp_replace(c, p, f"[{kind.upper()}]")
    return c


def bundle(tables: dict[str, DataFrame], ids: dict[str, tuple[str, ...]], salt: bytes, keep: tuple[str, ...] = (), places: bool = False) -> dict[str, DataFrame]:
    """Tables of a case for an export: every text column is masked, the id columns named in ids stay joinable.

    An id that holds a redacted value becomes ID- and the start of its keyed hash, the same in all tables. Columns in keep are not
    touched; latitude and longitude become null unless places. Arrays, maps and structs of texts are masked inside.
    """
    out = {}
    for name, df in tables.items():
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if f.name in ids.get(name, ()):
                c = c.cast("string")
                c = F.when(masked_text(c) != c, F.concat(F.lit("ID-"), F.left(keyed_hash(salt, c), F.lit(12)))).otherwise(c)
            elif f.name.lower() in ("latitude", "longitude") and not places:
                c = F.lit(None).cast(f.dataType)
            elif f.name not in keep:
                c = _deep(c, f.dataType)
            cols.append(c.alias(f.name))
        out[name] = df.select(*cols)
    return out


def _deep(c: Column, kind) -> Column:
    name = kind.typeName()
    if name == "string":
        return masked_text(c)
    if name == "array":
        return F.transform(c, lambda x: _deep(x, kind.elementType))
    if name == "map":
        return F.transform_values(c, lambda _, v: _deep(v, kind.valueType))
    if name == "struct":
        return F.when(c.isNotNull(), F.struct(*[_deep(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def redaction_log(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, replaced, different, documents: what an export's redaction touches."""
    parts = None
    for i, (kind, p, _) in enumerate(REDACTED):
        before = F.coalesce(F.col(text), F.lit(""))
        for k, q, _ in REDACTED[:i]:  # what an earlier kind has taken is no longer there
            before = F.regexp_replace(before, q, f"[{k.upper()}]")
        v = docs.select(F.xxhash64(*docs.columns).alias("row"), F.explode(F.regexp_extract_all(before, F.lit(p), F.lit(0))).alias("v")).select(F.lit(kind).alias("kind"), "row", F.lower("v").alias("v"))
        parts = v if parts is None else parts.unionByName(v)
    return parts.groupBy("kind").agg(F.count("*").alias("replaced"), F.count_distinct("v").alias("different"), F.count_distinct("row").alias("documents"))


def evidence_sheet(posts: DataFrame, key: str = "uid", text: str = "text", recorded: str = "sha256") -> DataFrame:
    """key, sha256, state of each post: 'unchanged' if its text still has the hash recorded at import, 'changed', or 'not recorded'."""
    now = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    state = F.when(F.col(recorded).isNull(), "not recorded").when(now == F.lower(recorded), "unchanged").otherwise("changed")
    return posts.select(key, now.alias("sha256"), state.alias("state"))
