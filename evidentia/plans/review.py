"""Flags by weighted rules, sounds of names, the link model, redaction, registers, work on cases, reasons of the evidence model."""

from pyspark.sql import functions as F

from ..documents import glossary
from ..functions import translit
from ..operators import evidence, flags, linkmodel, workflow
from ..sources import exports, imports, worlds
from ..sources.tables import ENTITIES_SQL as EN
from ..sources.tables import RELATIONSHIPS_SQL as RE
from ..sources.tables import entities, relationships, table
from .case_graph import case_edges
from .registry import query
from .scores import _EV as EVIDENCE
from .scores import evidence_input


@query("rule_flags")
def rule_flags(spark, d):
    """Flags of all documents by the weighted rules."""
    return flags.flags(table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "text"))


_KEY = "translate(regexp_replace(lower({}), '[^bcdfgjklmnpqrstvxz]', '', 'g'), 'gqxczjdbfv', 'kkkssstppp')"


@query("sound_keys", f"SELECT {_KEY.format('p_name')} AS sound, count(*) AS parts, min(p_partkey) AS first_part FROM part GROUP BY 1")
def sound_keys(spark, d):
    """Parts whose names sound alike."""
    return table(spark, d, "part").groupBy(translit.sound_key(F.col("p_name")).alias("sound")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query("sound_alike_places", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), g AS (SELECT {_KEY.format('n_name')} AS k, min(n_name) AS name, count(DISTINCT n_name) AS n FROM nation GROUP BY 1)
SELECT word, name, 'sound' AS how FROM w JOIN g ON {_KEY.format('word')} = k WHERE n = 1 AND length(k) >= 3""")
def sound_alike_places(spark, d):
    """Words of documents that sound like exactly one nation."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return translit.sound_alike(w.withColumn("latin", F.col("word")), table(spark, d, "nation").select(F.lit(None).cast("string").alias("native"), F.col("n_name").alias("name")))


@query("texts_in_latin")
def texts_in_latin(spark, d):
    """Documents with a letter of an Indian script or of Urdu, in Latin letters."""
    docs = table(spark, d, "documents").where(F.col("text").rlike("[؀-ۿݐ-ݿऀ-ൿﭐ-﷿ﹰ-﻾]"))
    return docs.select("doc_id", translit.in_latin("text").alias("latin"))


def case_rows(spark, d, relations=True):
    """Each case's verified returns as the link model reads them: edges, types, and relations of all kinds, which only suggestions name."""
    e = evidence.cut(case_edges(spark, d))
    edge = e.select("case", F.lit("edge").alias("kind"), "a", "b", F.lit(None).cast("string").alias("c"))
    kinds = entities(spark, d).select(F.col("case_number").alias("case"), F.lit("type").alias("kind"), F.col("id").alias("a"), F.col("entity_type").alias("b"), F.lit(None).cast("string").alias("c"))
    if not relations:
        return edge.unionByName(kinds)
    rel = relationships(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").distinct().join(e, ["a", "b"])
    return edge.unionByName(kinds).unionByName(rel.select("case", F.lit("relation").alias("kind"), "a", "b", F.col("relation").alias("c")))


@query("link_model_evaluation")
def link_model_evaluation(spark, d):
    return linkmodel.evaluation(case_rows(spark, d, relations=False))


@query("link_model_suggestions")
def link_model_suggestions(spark, d):
    return linkmodel.suggestions(case_rows(spark, d))


@query("link_explanations")
def link_explanations(spark, d):
    """What the model says of each case's first and last linked pair."""
    e = case_edges(spark, d)
    asked = e.groupBy("case").agg(F.array(F.min(F.struct("a", "b")), F.max(F.struct("a", "b"))).alias("p")).select("case", F.explode(F.array_distinct("p")).alias("p")).select("case", "p.a", "p.b")
    return linkmodel.explained(case_rows(spark, d), asked)


_CHOSEN = "ch AS (SELECT c_custkey, 'C' || c_custkey AS a, 'S' || (c_custkey % 10 + 1) AS b, CASE WHEN c_acctbal > 0 THEN 0.7 ELSE 0.3 END AS p FROM customer), ln AS (SELECT DISTINCT src, dst FROM rel WHERE state = 'verified')"


def _accepted(spark, d):
    c = table(spark, d, "customer")
    chosen = c.select(F.lit("all").alias("case"), F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("S"), F.col("c_custkey") % 10 + 1).alias("b"), F.when(F.col("c_acctbal") > 0, 0.7).otherwise(0.3).alias("probability"), F.lit(" pays to ").alias("relation"))
    return linkmodel.accepted(chosen, relationships(spark, d).select(F.lit("all").alias("case"), F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "state"), "reviewer")


@query("accepted_links", f"WITH {RE}, {_CHOSEN} SELECT a AS source, b AS target, 'PAYS_TO' AS relation, least(p, 0.5)::DOUBLE AS confidence, 'candidate' AS state FROM ch WHERE NOT EXISTS (SELECT 1 FROM ln WHERE src = a AND dst = b)")
def accepted_links(spark, d):
    """A supplier suggested to each customer, where the two are not linked yet."""
    return _accepted(spark, d)[0].select("source", "target", "relation", "confidence", "state")


@query("refused_links", f"WITH {RE}, {_CHOSEN} SELECT a, b, 'linked already' AS reason FROM ch WHERE EXISTS (SELECT 1 FROM ln WHERE src = a AND dst = b)")
def refused_links(spark, d):
    return _accepted(spark, d)[1].select("a", "b", "reason")


@query("workflow_snapshot", """WITH s AS (SELECT o_orderpriority AS case_number, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'started' ELSE 'done' END AS status, o_orderdate::DATE AS due FROM orders WHERE o_orderpriority < '4')
SELECT count(*) FILTER (status = 'pending') AS approvals_pending, count(*) FILTER (status <> 'done') AS deadlines_open, count(*) FILTER (status <> 'done' AND due < DATE '1997-01-01') AS deadlines_overdue FROM s""")
def workflow_snapshot(spark, d):
    """Orders as requests and as deadlines, of the cases of the three highest priorities."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "started").otherwise("done")
    rows = o.select(F.col("o_orderpriority").alias("case_number"), status.alias("status"), F.col("o_orderdate").cast("date").alias("due"))
    return workflow.snapshot(rows, rows, rows.where("case_number < '4'").select("case_number"), F.lit("1997-01-01").cast("date"))


_NOTICE = """h AS (SELECT DISTINCT c_name AS owner, n_name AS case_number, c_custkey || ':' || o_orderkey AS ref, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0),
acc AS (SELECT c_name AS owner, n_name AS case_number FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'MACHINERY')"""


@query("undelivered_hits", f"WITH {_NOTICE} SELECT owner AS user, case_number, ref FROM h JOIN acc USING (owner, case_number) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def undelivered_hits(spark, d):
    """Orders as hits of their customers' watch-lists; those of closed orders are told already, customers of one segment may not see them."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    h = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("owner"), (F.col("c_acctbal") > 0).alias("active"), F.col("n_name").alias("case_number"), F.col("c_custkey").alias("item"), F.col("o_orderkey").alias("source_key"), "o_orderstatus")
    known = h.where("o_orderstatus = 'F'").select(F.col("owner").alias("user"), "case_number", F.concat_ws(":", "item", "source_key").alias("ref"))
    return workflow.undelivered(h, c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_name").alias("user"), F.col("n_name").alias("case_number")), known)


@query("notice_recipients", "SELECT n_name AS case_number, c_name AS user FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def notice_recipients(spark, d):
    """Customers as users, their segments as roles; two roles may review."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    roles = spark.createDataFrame([("BUILDING", "review"), ("MACHINERY", "review"), ("FURNITURE", "view")], "role string, permission string")
    users = c.select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    return workflow.recipients(users, roles, c.select(F.col("n_name").alias("case_number"), F.col("c_name").alias("user")), "review")


@query("approved_requests", "SELECT o_orderkey AS ref, o_orderstatus = 'F' AND o_custkey % 10 <> o_orderkey % 10 AS approved FROM orders")
def approved_requests(spark, d):
    """Closed orders are approved requests, unless who asked also decided."""
    o = table(spark, d, "orders")
    wanted = o.select(F.lit("c").alias("case_number"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"))
    asked = o.select(F.lit("c").alias("case_number"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), (F.col("o_custkey") % 10).alias("asked_by"), (F.col("o_orderkey") % 10).alias("decided_by"))
    return workflow.approved(wanted, asked).select("ref", "approved")


_REGISTER = """reg AS (SELECT o_orderkey::VARCHAR AS number, 'FIRST INFORMATION REPORT' || chr(10) || '(structured-register import - awaiting human review)' || chr(10) || 'District: ' || n_name || chr(10) || 'FIR No: ' || o_orderkey || chr(10)
|| 'Complainant / Informant:' || chr(10) || 'Name: ' || c_name || chr(10) || 'Short Description of Incident: ' || o_orderpriority || chr(10) AS text, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _register(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    mapping = {"fir_number": "o_orderkey", "district": "n_name", "complainant": "c_name", "description": "o_orderpriority"}
    none = spark.createDataFrame([], "sha256 string")
    known = imports.register_documents(rows.where("o_orderstatus = 'P'"), mapping, none)[0].select("sha256")
    return imports.register_documents(rows, mapping, known)


@query("register_import", f"WITH {_REGISTER} SELECT number, sha256(text) AS sha256 FROM reg WHERE o_orderstatus <> 'P'")
def register_import(spark, d):
    """The register of orders as reports; those in progress are there already."""
    return _register(spark, d)[0].select("number", "sha256")


@query("register_rejects", f"WITH {_REGISTER} SELECT number, 'known already' AS reason FROM reg WHERE o_orderstatus = 'P'")
def register_rejects(spark, d):
    return _register(spark, d)[1]


@query("upload_checks", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN starts_with(text, '%PDF') ELSE false END AND coalesce(strlen(text), 0) > 0 AS valid FROM documents")
def upload_checks(spark, d):
    """Documents as uploads named .txt, .pdf and .exe."""
    suffix = F.element_at(F.array(F.lit(".txt"), F.lit(".pdf"), F.lit(".exe")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), suffix).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return imports.valid_uploads(files.withColumn("length", F.octet_length("content"))).select("doc_id", "valid")


_PH = r"(?:\+91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}"
_EM, _IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_FOUND = f"""fd AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '{_EM}')) AS v FROM documents UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(regexp_replace(text, '{_EM}', '[EMAIL]', 'g'), '{_IP}')) FROM documents
UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{_EM}', '[EMAIL]', 'g'), '{_IP}', '[IP]', 'g'), '{_PH}')) FROM documents)"""


@query("redaction_log", f"WITH {_FOUND} SELECT kind, count(*) AS replaced, count(DISTINCT lower(v)) AS different, count(DISTINCT doc_id) AS documents FROM fd GROUP BY 1")
def redaction_log(spark, d):
    return exports.redaction_log(table(spark, d, "documents").select("doc_id", "text"))


@query("redacted_texts", f"""WITH a AS (SELECT doc_id, list_distinct(list_concat(list_transform(regexp_extract_all(text, '{_EM}'), lambda x: 'e' || x), list_concat(list_transform(regexp_extract_all(text, '{_IP}'), lambda x: 'i' || x), list_transform(regexp_extract_all(text, '{_PH}'), lambda x: 'p' || x)))) AS l FROM documents)
SELECT doc_id, coalesce(len(l), 0)::INTEGER AS replaced, 0 AS still_there FROM a""")
def redacted_texts(spark, d):
    """How many values each document's labels replace, and how many addresses are still found in its text: none."""
    r = exports.redacted(table(spark, d, "documents"), b"export")
    still = sum((F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0))) for p in (_EM, _IP)), F.lit(0))
    return r.select("doc_id", "replaced", still.alias("still_there"))


@query("evidence_sheet", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN lang = 'fr' THEN 'not recorded' WHEN trim(text) = text THEN 'unchanged' ELSE 'changed' END AS state FROM documents")
def evidence_sheet(spark, d):
    """Documents against the hash of their trimmed texts, as if that had been imported; French ones have none."""
    docs = table(spark, d, "documents").withColumn("sha256", F.when(F.col("lang") != "fr", F.sha2(F.trim("text"), 256)))
    return exports.evidence_sheet(docs, "doc_id")


WORDS = [("de", "und", "and"), ("de", "der", "the"), ("de", "die", "the"), ("de", "nicht", "not"), ("fr", "et", "and"), ("fr", "le", "the"), ("fr", "la", "the"), ("fr", "pas", "not"), ("es", "y", "and"), ("es", "el", "the"), ("es", "la", "the"), ("es", "no", "not")]
_GLOSSARY = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in WORDS)


@query("glossary_reading", rf"""WITH g(lang, word, meaning) AS (VALUES {_GLOSSARY}), t AS (SELECT doc_id, lang, regexp_extract_all(text, 'https?://\S+|[^\s@]+@[^\s@]+\.\w+|[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+') AS k FROM documents),
u AS (SELECT doc_id, lang, unnest(k) AS w FROM t), c AS (SELECT u.doc_id, count(*) AS words, count(meaning) AS known FROM u LEFT JOIN g ON g.lang = u.lang AND g.word = lower(w) WHERE regexp_matches(w, '^[\p{{L}}\p{{M}}_]') AND NOT regexp_matches(w, '^(?:https?://.*|www\..*|[^\s@]+@[^\s@]+|.*\p{{N}}.*)$') GROUP BY 1)
SELECT doc_id, coalesce(words, 0) AS words, coalesce(known, 0) AS known, round(known / words, 6) AS coverage FROM t LEFT JOIN c USING (doc_id)""")
def glossary_reading(spark, d):
    """Coverage of a small glossary over all documents."""
    g = glossary.translated(table(spark, d, "documents"), spark.createDataFrame(WORDS, "lang string, word string, meaning string"))
    return g.select("doc_id", "words", "known", F.round("coverage", 6).alias("coverage"))


@query("closest_contacts", f"WITH {EVIDENCE}, pr AS (SELECT a, b FROM e WHERE a <> b AND event_type IN ('purchase', 'click', 'view')), cn AS (SELECT actor, other, count(*) AS n FROM (SELECT a AS actor, b AS other FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, other) AS rank FROM cn) SELECT actor, other, n, rank::INTEGER AS rank FROM rk WHERE rank <= 15")
def closest_contacts(spark, d):
    """The fifteen whom each user dealt with most."""
    _, money, comm, *_ = evidence_input(spark, d)
    return evidence.closest(money, comm)


@query("evidence_factors")
def evidence_factors(spark, d):
    return evidence.factors(evidence.cut(evidence.features(*evidence_input(spark, d))))


@query("lead_summaries")
def lead_summaries(spark, d):
    rows = evidence.cut(evidence.features(*evidence_input(spark, d)))
    return evidence.summaries(rows, evidence.scores(rows))


def world_rows(spark, seed=1, **settings):
    """Features of a made-up world, and its ring."""
    w = worlds.world(spark, seed, **settings)
    ev = evidence.cut(w["events"])
    of = lambda kind: ev.where(F.col("kind") == kind)
    places = of("MEET").select("id", "t", F.col("id").alias("place"), F.explode(F.array("a", "b")).alias("actor"))
    none = spark.createDataFrame([], "actor string, n long")
    return evidence.features(w["actors"], of("PAY"), of("CALL"), places, none, none, spark.createDataFrame([], "actor string, w double")), w["truth"]


@query("world_ablation")
def world_ablation(spark, d):
    """How well the evidence model finds the ring of a made-up world, as a whole and without one family of features."""
    return evidence.ablation(*world_rows(spark))
