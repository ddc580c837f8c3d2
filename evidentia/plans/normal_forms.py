"""Normal forms over the given tables, and counts of what they join."""

from pyspark.sql import functions as F

from ..functions import normal as n
from ..sources.tables import table
from .registry import query

_RE = "regexp_replace"


@query("doc_normalised_keys", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS spaced, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS compact, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]', '', 'g')) AS any_script, left(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS file_name FROM documents")
def doc_normalised_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(n.spaced(t)).alias("spaced"), F.md5(n.compact(t)).alias("compact"), F.md5(n.any_script_key(t)).alias("any_script"), n.safe_name(t).alias("file_name"))


_PH = "p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\+?[0-9][0-9 ()-]{8,15}[0-9]')) AS raw FROM documents), g AS (SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM p), c AS (SELECT doc_id, raw, d, CASE WHEN length(d) = 14 AND starts_with(d, '0091') THEN d[5:] WHEN length(d) = 13 AND starts_with(d, '091') THEN d[4:] WHEN length(d) = 12 AND starts_with(d, '91') THEN d[3:] WHEN length(d) = 11 AND starts_with(d, '0') THEN d[2:] ELSE d END AS m, CASE WHEN length(d) = 12 AND starts_with(d, '91') THEN d[3:] WHEN length(d) = 11 AND starts_with(d, '0') THEN d[2:] ELSE d END AS i FROM g)"


@query("doc_phone_forms", f"WITH {_PH} SELECT DISTINCT doc_id, raw, CASE WHEN regexp_full_match(m, '[6-9][0-9]{{9}}') THEN m ELSE '' END AS mobile, CASE WHEN regexp_full_match(i, '[6-9][0-9]{{9}}') THEN '+91' || i ELSE '' END AS international, CASE WHEN length(d) >= 10 THEN right(d, 10) ELSE '' END AS last_ten FROM c")
def doc_phone_forms(spark, d):
    """Runs of digits in texts that look like phone numbers, and their normal forms."""
    raw = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+?[0-9][0-9 ()-]{8,15}[0-9]"), F.lit(0))).alias("raw"))
    return raw.select("doc_id", "raw", n.mobile(F.col("raw")).alias("mobile"), n.international(F.col("raw")).alias("international"), n.last_ten(F.col("raw")).alias("last_ten")).distinct()


@query("code_forms", "SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS plate, regexp_matches(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '^(?:[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{1,4}|[0-9]{2}BH[0-9]{4}[A-Z]{1,2})$') AS valid, translate(p_brand, 'OoQIl|iZSsBGb', '0001111255866') AS digits, translate(p_brand, '015826', 'OISBZG') AS letters, regexp_replace(translate(lower(p_name), '013457$@!', 'oleastsai'), '[^a-z]', '', 'g') AS handle FROM part")
def code_forms(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", n.plate(b).alias("plate"), n.plate_valid(b).alias("valid"), n.ocr_digits(b).alias("digits"), n.ocr_letters(b).alias("letters"), n.handle_key(F.col("p_name")).alias("handle"))


_SH = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), 'https?://\S+|www\.\S+|@[\p{L}\p{N}_]+|#[\p{L}\p{N}_]+|\brt\b\s*:?|[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents)"""


@query("doc_shingles", f"WITH {_SH}, s AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM t) SELECT doc_id, len(w)::BIGINT AS words, len(s)::BIGINT AS shingles FROM s")
def doc_shingles(spark, d):
    t = table(spark, d, "documents").select("doc_id", n.words(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("words"), F.size(n.shingles(F.col("w"))).cast("long").alias("shingles"))


@query("url_forms", "WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[.,;:!?)\"'']+$', ''), '^(?i:https?)://', '') AS rest FROM pages), h AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', ''), ':.*$', '')), '^www\\.', '') AS domain FROM u) SELECT page_id, domain, domain || lower(regexp_replace(regexp_replace(regexp_replace(url, '[.,;:!?)]+$', ''), '^(?i:https?://)?(?i:www\\.)?[^/?#]+', ''), '/+$', '')) AS url_key FROM h")
def url_forms(spark, d):
    return table(spark, d, "pages").select("page_id", n.url_domain(F.col("url")).alias("domain"), n.url_key(F.col("url")).alias("url_key"))


@query("doc_snippets", "SELECT item_id, doc_id, CASE WHEN i < 0 THEN left(text, 140) ELSE CASE WHEN greatest(0, i - 70) > 0 THEN '…' ELSE '' END || substr(text, greatest(0, i - 70) + 1, least(length(text), i + length(needle) + 70) - greatest(0, i - 70)) || CASE WHEN least(length(text), i + length(needle) + 70) < length(text) THEN '…' ELSE '' END END AS snippet FROM (SELECT item_id, doc_id, d.text, needle, instr(lower(d.text), lower(needle)) - 1 AS i FROM (SELECT item_id, regexp_extract(text, '^([^ ]+ [^ ]+)', 1) AS needle FROM benchmark) JOIN documents d ON d.doc_id = item_id)")
def doc_snippets(spark, d):
    """The first two words of each benchmark item, in the context of the document of the same number."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", "^([^ ]+ [^ ]+)", 1).alias("needle"))
    j = table(spark, d, "documents").select("doc_id", "text").join(b, F.col("doc_id") == F.col("item_id"))
    return j.select("item_id", "doc_id", n.snippet(F.col("text"), F.col("needle")).alias("snippet"))


@query("deadline_states", "SELECT o_orderkey, datediff('day', DATE '1998-01-01', (o_orderdate + INTERVAL 90 DAY)::DATE) AS days_left, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN datediff('day', DATE '1998-01-01', (o_orderdate + INTERVAL 90 DAY)::DATE) < 0 THEN 'overdue' WHEN datediff('day', DATE '1998-01-01', (o_orderdate + INTERVAL 90 DAY)::DATE) <= 7 THEN 'at_risk' ELSE 'on_track' END AS state FROM orders")
def deadline_states(spark, d):
    """Deadlines 90 days after each order, on the first day of 1998."""
    due, today = F.date_add(F.col("o_orderdate").cast("date"), 90), F.lit("1998-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.datediff(due, today).cast("long").alias("days_left"), n.deadline_state(due, F.when(F.col("o_orderstatus") == "F", "done").otherwise("open"), today).alias("state"))


@query("deadline_counts", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN x < 0 THEN 'overdue' WHEN x <= 7 THEN 'at_risk' ELSE 'on_track' END AS state FROM (SELECT o_orderstatus, datediff('day', DATE '1998-01-01', (o_orderdate + INTERVAL 90 DAY)::DATE) AS x FROM orders)) GROUP BY 1")
def deadline_counts(spark, d):
    return deadline_states(spark, d).groupBy("state").agg(F.count("*").alias("n"))
