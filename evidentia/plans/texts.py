"""Documents: identifiers, links by shared keys, flags, redaction, watch lists, copies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.social import phrase_hits
from ..sources.tables import table
from .registry import query

_IDS = "ids AS (SELECT doc_id, source, 'email' AS kind, lower(unnest(regexp_extract_all(text, '{e}'))) AS value FROM documents UNION ALL SELECT doc_id, source, 'ip', unnest(regexp_extract_all(text, '{i}')) FROM documents UNION ALL SELECT doc_id, source, 'url', unnest(regexp_extract_all(text, '{u}')) FROM documents)".format(e=t.EMAIL, i=t.IPV4, u=t.URL)


def identifiers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.transform(t.found(F.col("text"), k), F.lower) if k == "email" else t.found(F.col("text"), k)).alias("values")) for k in t.PATTERNS])
    return docs.select("doc_id", "source", F.explode(kinds).alias("k")).select("doc_id", "source", "k.kind", F.explode("k.values").alias("value"))


@query("doc_identifiers", f"WITH {_IDS} SELECT doc_id, kind, value, count(*) AS n FROM ids GROUP BY ALL")
def doc_identifiers(spark, d):
    return identifiers(spark, d).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query("doc_identifier_counts", f"WITH {_IDS} SELECT kind, count(*) AS n, count(DISTINCT value) AS different, count(DISTINCT doc_id) AS docs FROM ids GROUP BY 1")
def doc_identifier_counts(spark, d):
    return identifiers(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("different"), F.countDistinct("doc_id").alias("docs"))


_LINK = f"WITH {_IDS}, k AS (SELECT DISTINCT doc_id, kind, value FROM ids), m AS (SELECT a.doc_id AS a, b.doc_id AS b, a.kind, count(*) AS n FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value AND a.doc_id < b.doc_id GROUP BY 1, 2, 3)"
WEIGHT = {"email": 0.5, "ip": 0.3, "url": 0.2}


@query("fir_links", _LINK + " SELECT a, b, sum(n)::BIGINT AS shared, round(least(1.0, sum(CASE kind WHEN 'email' THEN 0.5 WHEN 'ip' THEN 0.3 ELSE 0.2 END)), 4)::DOUBLE AS score FROM m GROUP BY 1, 2")
def fir_links(spark, d):
    """Documents that share identifiers; each kind counts once, the score is one at most."""
    k = identifiers(spark, d).select("doc_id", "kind", "value").distinct()
    j = k.select(F.col("doc_id").alias("a"), "kind", "value").join(k.select(F.col("doc_id").alias("b"), "kind", "value"), ["kind", "value"]).where("a < b")
    m = j.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))
    w = F.when(F.col("kind") == "email", 0.5).when(F.col("kind") == "ip", 0.3).otherwise(0.2)
    return m.groupBy("a", "b").agg(F.sum("n").alias("shared"), F.round(F.least(F.lit(1.0), F.sum(w)), 4).alias("score"))


@query("attribution_shared_keys", f"WITH {_IDS}, k AS (SELECT DISTINCT source, kind, value FROM ids) SELECT kind, value, count(*) AS sources FROM k GROUP BY 1, 2 HAVING count(*) > 1")
def attribution_shared_keys(spark, d):
    k = identifiers(spark, d).select("source", "kind", "value").distinct()
    return k.groupBy("kind", "value").agg(F.count("*").alias("sources")).where("sources > 1")


@query("doc_language_script", "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits FROM documents GROUP BY 1")
def doc_language_script(spark, d):
    x = table(spark, d, "documents")
    return x.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.sum(F.length(t.digits(F.col("text")))).cast("long").alias("digits"))


@query("phone_canonical", "SELECT c_custkey AS subject, right(regexp_replace('+91 ' || (9000000000 + c_custkey * 7), '[^0-9]', '', 'g'), 10) AS phone FROM customer")
def phone_canonical(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("subject"), t.canonical_phone(F.concat(F.lit("+91 "), (F.lit(9000000000) + F.col("c_custkey") * 7).cast("string"))).alias("phone"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')"


@query("url_info", f"SELECT page_id, {_HOST} AS host, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain FROM pages")
def url_info(spark, d):
    return table(spark, d, "pages").select("page_id", t.host(F.col("url")).alias("host"), t.domain(F.col("url")).alias("domain"))


@query("url_domain_counts", f"SELECT regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def url_domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(t.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query("redacted_docs", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{u}', '[URL]', 'g'), '{e}', '[EMAIL]', 'g'), '{i}', '[IP]', 'g')) AS redacted_sha256 FROM documents".format(e=t.EMAIL, i=t.IPV4, u=t.URL))
def redacted_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(t.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("pseudonym_labels", f"WITH {_IDS} SELECT DISTINCT value, 'EMAIL-' || substr(upper(sha256('case' || value)), 1, 8) AS label FROM ids WHERE kind = 'email'")
def pseudonym_labels(spark, d):
    return identifiers(spark, d).where("kind = 'email'").select("value", t.pseudonym(F.col("value"), "email").alias("label")).distinct()


@query("exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_WORDS = {k: " + ".join(f"CAST(contains(p, ' {w} ') AS BIGINT)" for w in ws) for k, ws in t.LEXICON.items()}
_FLAGS = f"f AS (SELECT doc_id, {_WORDS['insult']} AS insult, {_WORDS['contempt']} AS contempt FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ' AS p FROM documents))"


def flags(spark, d):
    x = table(spark, d, "documents").select("doc_id", t.words_of(F.col("text")).alias("words"))
    return x.select("doc_id", *[t.flagged(F.col("words"), k).cast("long").alias(k) for k in t.LEXICON])


@query("lexicon_flags", f"WITH {_FLAGS} SELECT doc_id, insult, contempt FROM f WHERE insult + contempt > 0")
def lexicon_flags(spark, d):
    return flags(spark, d).where("insult + contempt > 0")


_LAB = f"WITH {_FLAGS}, l AS (SELECT doc_id, toxic, insult + contempt AS score FROM f JOIN labels USING (doc_id))"


def scored(spark, d):
    return flags(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "toxic", (F.col("insult") + F.col("contempt")).alias("score"))


@query("flag_metrics", _LAB + " SELECT count(*) FILTER (score > 0 AND toxic = 1) AS tp, count(*) FILTER (score > 0 AND toxic = 0) AS fp, count(*) FILTER (score = 0 AND toxic = 1) AS fn, round(2.0 * count(*) FILTER (score > 0 AND toxic = 1) / (2 * count(*) FILTER (score > 0 AND toxic = 1) + count(*) FILTER (score > 0 AND toxic = 0) + count(*) FILTER (score = 0 AND toxic = 1)), 6) AS f1 FROM l")
def flag_metrics(spark, d):
    hit, bad = F.col("score") > 0, F.col("toxic") == 1
    m = scored(spark, d).agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"))
    return m.withColumn("f1", F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query("flag_auc", _LAB + ", r AS (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM l) SELECT round((sum(CASE WHEN toxic = 1 THEN r ELSE 0 END) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * (count(*) - sum(toxic))), 6) AS auc FROM r")
def flag_auc(spark, d):
    """Rank-sum, ties shared; counts per score first, so that the window runs over distinct scores."""
    c = scored(spark, d).groupBy("score").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("r", before + (F.col("n") + 1) / 2)
    a = r.agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.round((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


_PHRASE = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), ' ') || ' '"


@query("watch_hits", f"WITH n AS (SELECT doc_id, {_PHRASE} AS t FROM documents), b AS (SELECT item_id, {_PHRASE} AS p FROM benchmark) SELECT DISTINCT item_id, doc_id FROM n JOIN b ON contains(t, p) AND p <> '  '")
def watch_hits(spark, d):
    """Documents that hold the whole phrase of a benchmark item, word by word."""
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("term"), F.col("text").alias("phrase"))
    hits = phrase_hits(table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text"), terms)
    return hits.select(F.col("term").alias("item_id"), F.col("item").alias("doc_id"))


@query("triage_points", _LAB + " SELECT doc_id, (3 * score + 5 * toxic)::BIGINT AS points FROM l WHERE 3 * score + 5 * toxic > 0")
def triage_points(spark, d):
    return scored(spark, d).select("doc_id", (3 * F.col("score") + 5 * F.col("toxic")).cast("long").alias("points")).where("points > 0")


@query("thread_summary", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, arg_min(role, turn) AS opened_by, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def thread_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.min_by("role", "turn").alias("opened_by"), F.sum(F.length("text")).cast("long").alias("chars"))
