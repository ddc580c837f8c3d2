"""Measures of each case's graph: customers and suppliers of one region, joined by returned deliveries."""

from pyspark.sql import functions as F

from ..operators import casegraph as c
from ..sources.tables import ENTITIES_SQL as EN
from ..sources.tables import RELATIONSHIPS_SQL as RE
from ..sources.tables import entities, relationships
from .flows import EDGES, edges
from .registry import query

CASE = f"{EN}, {RE}, ce AS (SELECT DISTINCT x.case_number AS \"case\", least(src, dst) AS a, greatest(src, dst) AS b FROM rel JOIN ent x ON x.id = src JOIN ent y ON y.id = dst AND y.case_number = x.case_number WHERE state = 'verified' AND relation = 'R'), cw AS (SELECT \"case\", a, b FROM ce UNION ALL SELECT \"case\", b, a FROM ce)"


def case_edges(spark, d):
    """case, a < b: verified relationships of relation R within a case."""
    e, r = entities(spark, d), relationships(spark, d).where("state = 'verified' AND relation = 'R'").select("src", "dst").distinct()
    x, y = e.select(F.col("id").alias("src"), F.col("case_number").alias("case")), e.select(F.col("id").alias("dst"), F.col("case_number").alias("case2"))
    j = r.join(x, "src").join(y, "dst").where(F.col("case") == F.col("case2"))
    return j.select("case", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _rounded(df, *columns):
    return df.withColumns({x: F.round(x, 6) for x in columns})


@query("case_centralities")
def case_centralities(spark, d):
    return _rounded(c.centralities(case_edges(spark, d)), "degree", "betweenness", "pagerank", "eigenvector", "closeness", "clustering")


@query("case_degree", f"WITH {CASE}, n AS (SELECT \"case\", count(DISTINCT a) AS n FROM cw GROUP BY 1) SELECT \"case\", a AS node, count(*) AS links, round(count(*) / (any_value(n) - 1), 6) AS degree FROM cw JOIN n USING (\"case\") GROUP BY 1, 2")
def case_degree(spark, d):
    e = c.both_ways_by_case(case_edges(spark, d))
    n = e.groupBy("case").agg(F.countDistinct("a").alias("n"))
    return e.groupBy("case", F.col("a").alias("node")).agg(F.count("*").alias("links")).join(n, "case").select("case", "node", "links", F.round(F.col("links") / (F.col("n") - 1), 6).alias("degree"))


@query("roles")
def roles(spark, d):
    return c.roles(case_edges(spark, d))


@query("case_metrics")
def case_metrics(spark, d):
    return _rounded(c.metrics(case_edges(spark, d)), "avg_path", "modularity")


@query("critical_nodes")
def critical_nodes(spark, d):
    return c.critical_nodes(case_edges(spark, d), k=3, pool=40)


@query("case_removal")
def case_removal(spark, d):
    """What taking out each case's best linked node breaks."""
    deg = case_degree(spark, d).groupBy("case").agg(F.max(F.struct("links", "node")).alias("x")).select("case", F.col("x.node").alias("node"))
    return c.removal(case_edges(spark, d), deg)


@query("case_k_core", f"WITH RECURSIVE {CASE}, p AS (SELECT 0 AS i, \"case\", a, b FROM cw UNION ALL SELECT p.i + 1, p.\"case\", p.a, p.b FROM p JOIN (SELECT \"case\", a FROM p GROUP BY 1, 2 HAVING count(*) >= 3) s ON s.\"case\" = p.\"case\" AND s.a = p.a JOIN (SELECT \"case\", a AS b FROM p GROUP BY 1, 2 HAVING count(*) >= 3) t ON t.\"case\" = p.\"case\" AND t.b = p.b WHERE p.i < 40) SELECT DISTINCT \"case\", a AS node FROM p WHERE i = 40")
def case_k_core(spark, d):
    return c.k_core(case_edges(spark, d), 3)


_PM = f"{CASE}, dg AS (SELECT \"case\", a AS node, count(*) AS d FROM cw GROUP BY 1, 2), wd AS (SELECT x.\"case\", x.a AS u, y.a AS v, dg.d FROM cw x JOIN cw y ON x.\"case\" = y.\"case\" AND x.b = y.b AND x.a < y.a JOIN dg ON dg.\"case\" = x.\"case\" AND dg.node = x.b), pm AS (SELECT \"case\", u, v, count(*) AS common, sum(1 / ln(d + 1.0::DOUBLE)) AS aa, sum(1 / d::DOUBLE) AS ra FROM wd GROUP BY 1, 2, 3)"


@query("case_pair_measures", f"WITH {_PM} SELECT pm.\"case\", u, v, common, round(common / (x.d + y.d - common), 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS allocation, round(ln(1 + x.d * y.d::DOUBLE), 6) AS attachment FROM pm JOIN dg x ON x.\"case\" = pm.\"case\" AND x.node = u JOIN dg y ON y.\"case\" = pm.\"case\" AND y.node = v WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.\"case\" = pm.\"case\" AND ce.a = u AND ce.b = v)")
def case_pair_measures(spark, d):
    return _rounded(c.pair_measures(case_edges(spark, d)), "jaccard", "adamic_adar", "allocation", "attachment")


@query("connected_pairs")
def connected_pairs(spark, d):
    return c.metrics(case_edges(spark, d)).select("case", "pairs")


@query("path_details", f"WITH {EDGES}, e AS (SELECT src, dst, total AS confidence FROM edges), h(hop, src, dst) AS (VALUES (1, 0, 1), (2, 1, 2), (3, 2, 3)), c AS (SELECT hop, h.src, h.dst, confidence, 0 AS back FROM h JOIN e ON e.src = h.src AND e.dst = h.dst UNION ALL SELECT hop, h.src, h.dst, confidence, 1 FROM h JOIN e ON e.src = h.dst AND e.dst = h.src) SELECT hop::BIGINT AS hop, src::VARCHAR AS src, dst::VARCHAR AS dst, round(confidence, 1) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY hop ORDER BY back, confidence DESC) = 1")
def path_details(spark, d):
    """The payments along the path of the first four nations."""
    e = edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("PAID").alias("relation"), F.col("total").alias("confidence"))
    return c.path_details(e, ["0", "1", "2", "3"]).select("hop", "src", "dst", F.round("confidence", 1).alias("confidence"))


@query("hidden_paths", f"WITH {EDGES}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(total) AS c FROM edges GROUP BY 1, 2), w AS (SELECT a, b, c FROM p UNION ALL SELECT b, a, c FROM p), h2 AS (SELECT [x.a, x.b, y.b] AS path, 2 AS hops, (x.c + y.c) / 2 AS c FROM w x JOIN w y ON y.a = x.b AND y.b <> x.a WHERE x.a = 0 AND y.b = 1 AND x.b <> 1) SELECT array_to_string(path, '-') AS path, hops::BIGINT AS hops, round(c, 1) AS confidence FROM h2 ORDER BY round(c, 4) DESC, h2.path LIMIT 10")
def hidden_paths(spark, d):
    """Ways of two hops and more from the first nation to the second, over the payments of all nations."""
    p = edges(spark, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("total").alias("confidence"))
    found = c.hidden_paths(p, 0, 1, most=2)
    return found.select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "hops", F.round("confidence", 1).alias("confidence"))
