"""Secrets in whole texts, and how far each is copied: DataFrame functions only.

Candidates are found by three kinds of patterns. Their positions come from splitting the text at the matches, so that they
are the leftmost non-overlapping ones. The hash of each candidate's value is then counted over the corpus by distinct
owners and repositories: a value that at least EXAMPLE_OWNERS owners hold, or more than one owner in at least
EXAMPLE_REPOSITORIES repositories, is a widely copied example; another one that looks drawn at random is live. The method
adds spans of the kinds `live` and `example` around the value. Candidates are found once and kept in the checkpoint folder.
Values that would fill a task are few; their counts are broadcast, all others are joined by hash.

Nulls count as empty texts; texts without a match have zero counts, the hash of nothing and empty spans. Each repeated row
gets the same result. A null owner or repository counts as one owner, the unnamed. Very long texts cost time in
proportion to their length. Equal values tie in nothing: they share one class. An empty table gives no rows. Other columns of
the input may have any names. Offsets are in code points, the end excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, unused


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""(?:{_NAMES})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "(AKIA[A-Z0-9]{16,})"
HEX = "([0-9a-f]{24,})"
#: Kind, pattern (its group is the value), fewest characters of the value; in the order in which ties are listed.
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
ADDED = ("example", "live")
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Keys of 64 characters and short lists that are broadcast at most; more are joined by a shuffle.
FEW = 200_000
PLACEHOLDER = "(?i)example|changeme|your|dummy|sample|xxxx"


def candidates(docs: DataFrame, key: list[str], text: str, owner: Column, repository: Column) -> DataFrame:
    """key, owner, repository, kind, ord, start, end, value_start, value: one row per match, one text per key."""
    found = F.lit(False)
    for _, pattern, _ in KINDS:
        found = found | F.col(text).rlike(pattern)
    hits = docs.where(found).groupBy(*key).agg(F.first(text).alias("_t"), F.first(owner).alias("owner"), F.first(repository).alias("repository"))
    t, each = F.col("_t"), []
    for n, (kind, pattern, least) in enumerate(KINDS):
        gaps = F.transform(F.split(t, pattern, -1), F.length)
        parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("value"))
        one = hits.where(t.rlike(pattern)).select(*key, "owner", "repository", F.lit(kind).alias("kind"), F.lit(n).alias("ord"), F.lit(least).alias("least"), F.posexplode(parts).alias("pos", "p"))
        each.append(one.where(F.col("p.match").isNotNull()).select(*key, "owner", "repository", "kind", "ord", "least", "pos", "p.gap", "p.value", F.length("p.match").alias("size")))
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    before = Window.partitionBy(*key, "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.withColumn("value_start", F.col("end") - F.length("value"))
    return rows.where(F.length("value") >= F.col("least")).select(*key, "owner", "repository", "kind", "ord", "start", "end", "value_start", "value")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, owners, repositories, copies: over the whole corpus."""
    held = found.groupBy(F.sha2("value", 256).alias("value_hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("copies"))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))


def looks_live(value: Column) -> Column:
    """Twelve characters or more, letters and digits, no placeholder word."""
    return (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def classified(docs: DataFrame, key: list[str], text: str, owner: Column, repository: Column) -> DataFrame:
    """candidates() with owners, repositories, copies and class: example, live or weak."""
    found = cut(candidates(docs, key, text, owner, repository))
    held = cut(ownership(found))
    rows = found.drop("repository").withColumn("value_hash", F.sha2("value", 256))
    most = max(1000, found.count() // parts(docs.sparkSession))
    hot = F.broadcast(held.where(F.col("copies") > most))  # fewer than there are shuffle partitions
    common = rows.join(hot, "value_hash")
    rare = rows.join(hot.select("value_hash"), "value_hash", "left_anti").join(held.where(F.col("copies") <= most), "value_hash")
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    kind = F.when(copied, "example").when(looks_live(F.col("value")), "live").otherwise("weak")
    return common.unionByName(rare).withColumn("class", kind)


def scan(docs: DataFrame, key: list[str], text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per key with a match: n_assign, n_access, n_hex, base_sha256, spans, and live (spans to take out)."""
    rows = classified(docs, key, text, F.col("source") if owner is None else owner, F.concat_ws("/", "source", "lang") if repository is None else repository)
    span = F.struct(F.col("start").alias("start"), F.col("ord").alias("ord"), F.col("end").alias("end"), F.col("kind").alias("kind"))
    extra = F.when(F.col("class") != "weak", F.struct(F.col("value_start").alias("start"), F.when(F.col("class") == "example", 3).otherwise(4).alias("ord"), F.col("end").alias("end"), F.col("class").alias("kind")))
    got = rows.groupBy(*key).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, _, _ in KINDS],
        F.array_sort(F.collect_list(span)).alias("base"),
        F.array_sort(F.collect_set(extra)).alias("more"),
        F.array_sort(F.collect_set(F.when(F.col("class") != "example", F.struct(F.col("value_start").alias("start"), F.col("end").alias("end"))))).alias("live"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return got.select(*key, "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "more"))).alias("spans"), "live")


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.coalesce("source", F.lit("\x01")), F.coalesce("lang", F.lit("\x01")), "text"), 256))


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """df, kept, and marked for a broadcast if it has FEW rows at most; whether it has."""
    df = cut(df)
    few = df.count() <= FEW
    return (F.broadcast(df) if few else df), few


def op4_secrets(docs: DataFrame) -> DataFrame:
    """Contract columns of op4 for every row of docs."""
    keyed = _keyed(docs.select("doc_id", "text", "source", "lang"), "_key")
    found, _ = _small(scan(keyed, ["_key"]).drop("live"))
    rows = keyed.select("doc_id", "_key").join(found, "_key", "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k, _, _ in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the value of every candidate replaced by mark, save those of widely copied examples."""
    key, out, live = (unused(docs, n) for n in ("_key", "_out", "_live"))
    found = scan(_keyed(docs.select("doc_id", "text", "source", "lang"), "_key"), ["_key"])
    found, few = _small(found.where(F.size("live") > 0).select(F.col("_key").alias(key), F.col("live").alias(live)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    t = F.col("text")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))).alias("out"))
    )
    matches = F.coalesce(t.rlike("|".join(p for _, p, _ in KINDS)), F.lit(False))
    joined = _keyed(docs if few else docs.where(matches), key).join(found, key, "left")
    done = F.when(F.col(live).isNotNull(), F.aggregate(live, start, step))
    clean = joined.withColumn(out, done).withColumn("text", F.when(F.col(out).isNull(), t).otherwise(F.concat(F.col(out)["out"], F.substr(t, (F.col(out)["at"] + 1).cast("int"), F.lit(2**31 - 1)))))
    clean = clean.select(*docs.columns)
    return clean if few else docs.where(~matches).unionByName(clean)  # texts without a match are never shuffled


def op4_sql() -> str:
    """The same in DuckDB."""
    q = lambda s: s.replace("'", "''")
    raw = " UNION ALL ".join(
        f"SELECT rid, source, lang, '{k}' AS kind, {n} AS ord, {least} AS least, regexp_split_to_array(text, '{q(p)}') AS p, regexp_extract_all(text, '{q(p)}', 0) AS m, regexp_extract_all(text, '{q(p)}', 1) AS v FROM d WHERE regexp_matches(text, '{q(p)}')" for n, (k, p, least) in enumerate(KINDS)
    )
    names = lambda c: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e), '') AS {c}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
raw AS ({raw}),
ex AS (SELECT rid, source, lang, kind, ord, least, unnest(range(1, len(m) + 1)) AS i, p, m, v FROM raw),
sp AS (SELECT rid, source, lang, kind, ord, least, v[i] AS val,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e, length(m[i]) AS n FROM ex),
base AS (SELECT rid, source, lang, kind, ord, (e - n)::BIGINT AS s, e::BIGINT AS e, val FROM sp WHERE length(val) >= least),
freq AS (SELECT val, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), coalesce(concat_ws('/', source, lang), ''))) AS repositories FROM base GROUP BY val),
cls AS (SELECT b.*, CASE WHEN owners >= {EXAMPLE_OWNERS} OR owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN length(val) >= 12 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND NOT regexp_matches(val, '{PLACEHOLDER}') THEN 'live' ELSE 'weak' END AS class FROM base b JOIN freq USING (val)),
more AS (SELECT DISTINCT rid, class AS kind, CASE class WHEN 'example' THEN 3 ELSE 4 END AS ord, e - length(val) AS s, e FROM cls WHERE class <> 'weak'),
spans AS (SELECT rid, {names("spans")} FROM (SELECT rid, kind, ord, s, e FROM base UNION ALL SELECT rid, kind, ord, s, e FROM more) GROUP BY rid),
agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256({names("x").removesuffix(" AS x")}) AS base_sha256 FROM base GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (rid) LEFT JOIN spans USING (rid)"""
