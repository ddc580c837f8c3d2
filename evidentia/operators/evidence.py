"""Evidence model: what the records of a case say of each actor, as 18 features, and a lead priority with an uncertainty band.

The weights are set by hand and open to argument; nothing is learned, and the result asks for human verification.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as n
from . import casegraph
from .graph import cut

# Feature, family, weight, offset and scale of the saturation (no scale: held at 1), whether percentiles count.
FEATURES = (
    ("pagerank", "structure", 0.6, 1.0, 2.0, True),
    ("betweenness", "structure", 0.8, 0.0, 0.05, True),
    ("degree", "structure", 0.5, 0.0, 6.0, True),
    ("kcore", "structure", 0.4, 1.0, 3.0, True),
    ("bridging", "structure", 0.6, 0.0, 2.0, True),
    ("money_volume", "money", 0.5, 0.0, 500000.0, True),
    ("money_fan", "money", 0.5, 0.0, 5.0, True),
    ("pass_through", "money", 1.0, 0.0, None, False),
    ("money_to_accused", "money", 1.2, 0.0, 3.0, False),
    ("comm_with_accused", "comm", 1.2, 0.0, 5.0, False),
    ("comm_burst", "comm", 0.5, 2.0, 6.0, True),
    ("comm_reach", "comm", 0.3, 0.0, 8.0, True),
    ("meet_accused", "coloc", 1.0, 0.0, 3.0, False),
    ("copresence", "coloc", 0.5, 0.0, 6.0, True),
    ("fir_appearances", "fir", 1.0, 1.0, 1.5, False),
    ("cross_fir_identifiers", "fir", 1.6, 0.0, 1.0, False),
    ("alerts", "alerts", 1.0, 0.0, 1.5, False),
    ("recency", "recency", 0.4, 0.0, None, False),
)
# Greatest sum of each family, what each role adds, and the bias.
FAMILY_CAP = {"structure": 2.0, "money": 3.0, "comm": 2.0, "coloc": 1.6, "fir": 2.4, "alerts": 1.5, "recency": 0.4}
ROLE_PRIOR = {"accused": 2.2, "suspect": 1.6, "": 0.0, "witness": -2.5, "complainant_relative": -2.0, "complainant": -3.5, "victim": -4.0}
BIAS, DISMISSED, ROLE_UNKNOWN_SD, HIGH, MEDIUM = -4.0, 3.0, 1.0, 65, 40
PASS_S, BURST_S, COPRESENCE_S = 48 * 3600, 6 * 3600, 3 * 3600
EXCLUDED = ("victim", "complainant", "witness", "complainant_relative")


def owned(events: DataFrame, owners: DataFrame) -> DataFrame:
    """events (id, t, kind, a, b, amount) between the actors who own the ends; an amount is shared among the pairs of owners."""
    x = events.join(owners.select(F.col("item").alias("a"), F.col("actor").alias("x")), "a").join(owners.select(F.col("item").alias("b"), F.col("actor").alias("y")), "b").where("x <> y")
    share = x.groupBy("id").agg(F.count("*").alias("pairs"))
    return x.join(share, "id").select("id", "t", "kind", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("amount") / F.col("pairs")).alias("amount"))


def pass_through(money: DataFrame) -> DataFrame:
    """actor, pass_through: how much of what came in left within two days, to others than its sender; first in, first out."""
    flow = money.select(F.col("b").alias("actor"), "t", "amount", F.col("a").alias("other"), F.lit(True).alias("inn"), "id").unionByName(money.select(F.col("a").alias("actor"), "t", "amount", F.col("b").alias("other"), F.lit(False).alias("inn"), "id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        came, left = pdf[pdf.inn], pdf[~pdf.inn]
        total, passed, first = float(came.amount.sum()), 0.0, 0
        rest, when, who = left.amount.astype(float).tolist(), left.t.tolist(), left.other.tolist()
        for t, need, source in zip(came.t.tolist(), came.amount.astype(float).tolist(), came.other.tolist(), strict=True):
            while first < len(rest) and (when[first] < t or rest[first] <= 1e-9):
                first += 1  # what left before this came, or is used up, serves nothing that comes later
            for i in range(first, len(rest)):
                if need <= 1e-9 or when[i] - t > PASS_S:
                    break
                if who[i] == source:
                    continue
                take = min(rest[i], need)
                rest[i] -= take
                need -= take
                passed += take
        share = passed / total if total > 0 else 0.0
        return pd.DataFrame({"actor": [pdf.actor.iloc[0]], "share": [share], "came": [len(came)]})

    # Only for those to whom and from whom money went are the payments gone through; nothing passes through others.
    ways = flow.groupBy("actor").agg((F.bool_or("inn") & ~F.bool_and("inn")).alias("both"))
    got = flow.join(ways.where("both"), "actor", "left_semi").groupBy("actor").applyInPandas(run, "actor string, share double, came long")
    got = got.unionByName(ways.where("NOT both").select("actor", F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("came")))
    return got.select("actor", (F.col("share") * (1 - F.exp(-F.col("came") / 2.0))).alias("pass_through"))


def trailing_peak(touched: DataFrame) -> DataFrame:
    w = Window.partitionBy("actor").orderBy("t").rangeBetween(-BURST_S, 0)
    return touched.withColumn("n", F.count("*").over(w)).groupBy("actor").agg(F.max("n").cast("double").alias("comm_burst"))


def copresence(places: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """x, y, n: how often two actors were at one place within three hours. places: id, t, place, actor; others: where y is sought, if elsewhere.

    Records that no other row of theirs names are counted as they meet; pairs of others are told apart by their ids.
    """
    once = lambda p: p.withColumn("own", F.count("*").over(Window.partitionBy("id")) == 1)
    p, o = once(places), once(places if others is None else others)
    left = p.select("place", F.floor(F.col("t") / COPRESENCE_S).alias("slot"), "t", "actor", "id", "own")
    right = o.select("place", F.explode(F.array(*[F.floor(F.col("t") / COPRESENCE_S) + i for i in (-1, 0, 1)])).alias("slot"), F.col("t").alias("u"), F.col("actor").alias("other"), F.col("id").alias("id2"), F.col("own").alias("own2"))
    met = left.join(right, ["place", "slot"]).where((F.col("actor") != F.col("other")) & (F.abs(F.col("t") - F.col("u")) <= COPRESENCE_S))
    alone = F.col("own") & F.col("own2")
    return met.groupBy(F.col("actor").alias("x"), F.col("other").alias("y")).agg((F.count_if(alone) + F.count_distinct(F.when(~alone, F.struct(F.least("id", "id2"), F.greatest("id", "id2"))))).alias("n"))


def twins(ends: DataFrame, places: DataFrame) -> DataFrame:
    """actor, twin (first of the actors with the same records), nth among them, size. ends: actor, other.

    Actors are twins who deal with the same others and were at the same places at the same times. Of records that several rows of
    places name, the ids must be the same, too. Twins meet and deal with all others alike.
    """
    stays = places.select("actor", "place", "t", F.when(F.count("*").over(Window.partitionBy("id")) > 1, F.col("id")).alias("id")).where("actor IS NOT NULL")
    empty = lambda kind: F.lit(None).cast(kind)
    records = ends.select("actor", "other", empty("string").alias("place"), empty("long").alias("t"), empty("string").alias("id")).unionByName(stays.select("actor", empty("string").alias("other"), F.col("place").cast("string").alias("place"), "t", F.col("id").cast("string").alias("id")))
    key = records.groupBy("actor").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("other", "place", "t", "id")))), 256).alias("key"))
    w = Window.partitionBy("key")
    return key.select("actor", F.min("actor").over(w).alias("twin"), F.row_number().over(w.orderBy("actor")).alias("nth"), F.count("*").over(w).alias("size"))


def _dealings(actors: DataFrame, money: DataFrame, comm: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payments and contacts seen from both ends, with a mark where the other is an accused or suspect; and these seeds."""
    seeds = actors.where(F.col("role").isin("accused", "suspect")).select(F.col("actor").alias("other"), F.lit(1).alias("seed"))
    both = lambda e: e.select(F.col("a").alias("actor"), F.col("b").alias("other"), "t", "amount", F.lit("out").alias("way"), "id").unionByName(e.select(F.col("b").alias("actor"), F.col("a").alias("other"), "t", "amount", F.lit("in").alias("way"), "id"))
    return cut(both(money).join(seeds, "other", "left")), cut(both(comm).join(seeds, "other", "left")), seeds


def _by_money(m: DataFrame) -> DataFrame:
    fan = lambda way: F.count_distinct(F.when(F.col("way") == way, F.col("other")))
    return m.groupBy("actor").agg(F.sum("amount").alias("money_volume"), F.greatest(fan("in"), fan("out")).cast("double").alias("money_fan"), F.count("seed").cast("double").alias("money_to_accused"), F.count("*").alias("obs_money"))


def _by_comm(c: DataFrame) -> DataFrame:
    return c.groupBy("actor").agg(F.count_distinct("other").cast("double").alias("comm_reach"), F.count("seed").cast("double").alias("comm_with_accused"), F.count("*").alias("obs_comm"))


def counts(actors: DataFrame, money: DataFrame, comm: DataFrame) -> DataFrame:
    """actor and those features that count payments and contacts; nothing of the network is built for them."""
    m, c, _ = _dealings(actors, money, comm)
    out = actors.select("actor")
    for p in (_by_money(m), _by_comm(c), trailing_peak(c.select("actor", "t"))):
        out = out.join(p, "actor", "left")
    return out.select("actor", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("money_volume", "money_fan", "money_to_accused", "comm_reach", "comm_with_accused", "comm_burst")])


def features(actors: DataFrame, money: DataFrame, comm: DataFrame, places: DataFrame, appearances: DataFrame, identifiers: DataFrame, alerts: DataFrame) -> DataFrame:
    """actor, role, the features, and obs_*: how many records of each family there are.

    actors: actor, role. money, comm: id, t, a, b, amount. places: id, t, place, actor. appearances: actor, n. identifiers:
    actor, n (shared over documents). alerts: actor, w (severity times confidence).
    """
    money, comm, places = cut(money), cut(comm), cut(places)  # each is read many times
    m, c, seeds = _dealings(actors, money, comm)
    by_money, by_comm = _by_money(m), _by_comm(c)
    e = money.select("a", "b").unionByName(comm.select("a", "b")).where("a <> b")
    ends = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("actor"), F.col("b").alias("other")))
    kin = cut(twins(ends, places))
    first = kin.where("nth = 1").select("actor")
    # One actor of each class meets one of each other class, and a second one of its own.
    there = kin.where("nth <= 2").select(F.col("actor").alias("y"), F.col("twin").alias("q"), "nth", "size")
    some = places.join(there.select(F.col("y").alias("actor")), "actor", "left_semi")
    met = copresence(some.join(first, "actor", "left_semi"), some).join(there, "y").where("nth = 1 OR q = x")
    met = cut(met.select("x", "q", "n", (F.col("size") - F.when(F.col("q") == F.col("x"), 1).otherwise(0)).alias("others")))
    among = kin.join(seeds.withColumnRenamed("other", "actor"), "actor").groupBy(F.col("twin").alias("q")).agg(F.count("*").alias("seeds"))
    by_class = met.join(among, "q", "left").groupBy(F.col("x").alias("twin")).agg(F.sum("others").cast("double").alias("copresence"), F.sum(F.col("n") * F.coalesce("seeds", F.lit(0))).alias("seen"), F.sum(F.when(F.col("q") == F.col("x"), F.col("n"))).alias("own"), F.sum(F.col("n") * F.col("others")).alias("obs_coloc"))
    by_place = kin.join(by_class, "twin").join(seeds.withColumnRenamed("other", "actor"), "actor", "left")  # no seed meets itself
    by_place = by_place.select("actor", "copresence", (F.col("seen") - F.when(F.col("seed") == 1, F.coalesce("own", F.lit(0))).otherwise(0)).cast("double").alias("meet_accused"), "obs_coloc")
    seen = m.select("actor", "t").unionByName(c.select("actor", "t")).unionByName(places.select("actor", "t"))
    last = seen.groupBy("actor").agg(F.max("t").alias("t")).crossJoin(F.broadcast(seen.agg(F.max("t").alias("now"))))  # one row
    recency = last.select("actor", F.exp(-(F.col("now") - F.col("t")) / 86400.0 / 45.0).alias("recency"), F.lit(1).alias("obs_recency"))
    links = ends.join(first, "actor", "left_semi").join(kin.select(F.col("actor").alias("other"), F.col("twin").alias("q")), "other").select(F.col("actor").alias("p"), "q").unionByName(met.select(F.col("x").alias("p"), "q"))
    graph = links.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(False).alias("twin")).distinct().unionByName(kin.where("nth > 1").select(F.col("twin").alias("a"), F.col("actor").alias("b"), F.lit(True).alias("twin")))
    graph = cut(graph.select(F.lit("all").alias("case"), "a", "b", "twin"))
    shape = cut(casegraph.centralities(graph, ("pagerank", "betweenness", "core", "community")).withColumnRenamed("node", "actor").join(kin.select("actor", "twin"), "actor"))
    next_to = graph.where("NOT twin").select(F.col("a").alias("twin"), F.col("b").alias("q")).unionByName(graph.where("NOT twin AND a <> b").select(F.col("b").alias("twin"), F.col("a").alias("q")))
    held = shape.groupBy(F.col("twin").alias("q")).agg(F.collect_set("community").alias("held"), F.count("*").alias("nodes"))
    around = next_to.join(held, "q").groupBy("twin").agg(F.sum(F.col("nodes") - F.when(F.col("q") == F.col("twin"), 1).otherwise(0)).alias("links"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("around"))
    size = shape.agg(F.count("*").alias("size"))
    struct = shape.join(around, "twin").crossJoin(F.broadcast(size)).select(  # one row
        "actor", (F.col("pagerank") * F.col("size")).alias("pagerank"), "betweenness", F.col("links").cast("double").alias("degree"), F.col("core").cast("double").alias("kcore"),
        F.when(F.col("links") >= 2, F.size(F.array_remove("around", F.col("community")))).otherwise(0).cast("double").alias("bridging"), F.col("links").alias("obs_structure"),
    )
    parts = [struct, by_money, pass_through(money), by_comm, trailing_peak(c.select("actor", "t")), by_place, appearances.select("actor", F.col("n").cast("double").alias("fir_appearances"), F.col("n").alias("obs_fir")), identifiers.select("actor", F.col("n").cast("double").alias("cross_fir_identifiers")), alerts.groupBy("actor").agg(F.sum("w").alias("alerts"), F.lit(5).alias("obs_alerts")), recency]
    out = actors.select("actor", "role")
    for p in parts:
        out = out.join(p, "actor", "left")
    names = [f[0] for f in FEATURES]
    obs = [f"obs_{f}" for f in FAMILY_CAP]
    return out.select("actor", F.coalesce("role", F.lit("")).alias("role"), *[F.coalesce(c_, F.lit(0.0)).alias(c_) for c_ in names], *[F.coalesce(c_, F.lit(0)).cast("long").alias(c_) for c_ in obs])


def _scaled(rows: DataFrame) -> tuple[DataFrame, dict, dict]:
    """rows with s_*, each feature between 0 and 1, and the families' sums, plain and held below their caps."""
    plain = ~F.col("role").isin(*EXCLUDED)
    count = rows.agg(F.count_if(plain).alias("_pop"))
    r = rows.crossJoin(F.broadcast(count)).withColumn("_alpha", 0.5 * F.least(F.lit(1.0), F.col("_pop") / 20.0))  # one row
    for name, _, _, offset, scale, use in FEATURES:
        x = F.col(name)
        own = F.when(x > 0, n.saturated(x - offset, scale) if scale else F.least(F.lit(1.0), x)).otherwise(0.0)
        if use:
            counts = rows.where(plain).groupBy(name).agg(F.count("*").alias("_c"))
            below = F.coalesce(F.sum("_c").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            pct = counts.select(F.col(name).alias("_v"), ((below + 0.5 * F.col("_c"))).alias("_p"))
            r = r.join(pct, F.col(name) == F.col("_v"), "left")
            own = F.when((x > 0) & F.col("_p").isNotNull(), (1 - F.col("_alpha")) * own + F.col("_alpha") * F.col("_p") / F.col("_pop")).otherwise(own)
        r = r.withColumn(f"s_{name}", own)
        if use:
            r = r.drop("_v", "_p")
    total = {f: sum((F.lit(w) * F.col(f"s_{k}") for k, fam, w, *_ in FEATURES if fam == f), F.lit(0.0)) for f in FAMILY_CAP}
    held = {f: cap * F.tanh(total[f] / cap) for f, cap in FAMILY_CAP.items()}
    return r, total, held


def scores(rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """actor, role, logit, score, low, high, tier, status, rank. rows: features(). decisions: actor, decision (the latest).

    Actors in a victim's, complainant's or witness's role are scored, but not ranked, and not part of the percentiles.
    """
    plain = ~F.col("role").isin(*EXCLUDED)
    r, total, held = _scaled(rows)
    other = sum((total[f] for f in FAMILY_CAP if f != "recency"), F.lit(0.0))
    prior = F.lit(0.0)
    for role, p in ROLE_PRIOR.items():
        prior = F.when(F.col("role") == role, p).otherwise(prior)
    logit = BIAS + prior + sum((held[f] for f in FAMILY_CAP if f != "recency"), F.lit(0.0)) + held["recency"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), other) / 1.5)
    spread = sum((F.pow(F.lit(w * 0.5) / F.sqrt(1.0 + F.col(f"obs_{fam}")), F.lit(2.0)) for _, fam, w, *_ in FEATURES), F.lit(0.0)) + F.when(F.col("role") == "", ROLE_UNKNOWN_SD**2).otherwise(0.0)
    r = r.withColumn("logit", logit).withColumn("sd", F.sqrt(spread))
    r = r.join(decisions.select("actor", "decision"), "actor", "left") if decisions is not None else r.withColumn("decision", F.lit(None).cast("string"))
    status = F.when(F.col("decision") == "confirmed_person_of_interest", "confirmed").when(F.col("decision") == "dismissed", "dismissed").when(F.col("decision") == "needs_more_info", "needs_more_info").otherwise("open")
    r = r.withColumn("status", status).withColumn("logit", F.col("logit") - F.when(F.col("status") == "dismissed", DISMISSED).otherwise(0.0))
    pct = lambda x: F.round(n.sigmoid(x) * 100).cast("long")
    r = r.withColumns({"score": pct(F.col("logit")), "low": pct(F.col("logit") - 1.28 * F.col("sd")), "high": pct(F.col("logit") + 1.28 * F.col("sd"))})
    exact = n.sigmoid(F.col("logit")) * 100
    tier = F.when(exact >= HIGH, "High").when(exact >= MEDIUM, "Medium").otherwise("Low")
    layer = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "dismissed", 2).otherwise(1)
    ranked = plain.alias("plain")
    w = Window.partitionBy("plain").orderBy("layer", F.desc("logit"), "actor")
    r = r.withColumn("tier", tier).withColumn("layer", layer).withColumn("plain", ranked)
    return r.withColumn("rank", F.when(F.col("plain"), F.row_number().over(w))).select("actor", "role", F.round("logit", 3).alias("logit"), "score", "low", "high", F.round("sd", 2).alias("sd"), "tier", "status", "rank")


# What each feature says, with its value.
SENTENCES = {
    "pagerank": "Stands in the middle of the recorded network, with %.1f times the influence of an average person.",
    "betweenness": "Lies on shortest ways between others, as go-betweens do (share %.3f).",
    "degree": "Has %.0f different associates in the records.",
    "kcore": "Belongs to a group whose members all have at least %.0f links among each other.",
    "bridging": "Links %.0f groups that are apart otherwise.",
    "money_volume": "INR %,.0f went through the accounts.",
    "money_fan": "Payments spread to, or come from, %.0f parties.",
    "pass_through": "Of what came in, a share of %.2f left again within 48 hours.",
    "money_to_accused": "%.0f payments with people linked to an accused.",
    "comm_with_accused": "%.0f calls or messages with people linked to an accused.",
    "comm_burst": "%.0f calls or messages within six hours.",
    "comm_reach": "Calls or messages with %.0f different contacts.",
    "meet_accused": "%.0f recorded meetings with people linked to an accused.",
    "copresence": "Was at one place and time with %.0f different people.",
    "fir_appearances": "Appears in %.0f separate reports.",
    "cross_fir_identifiers": "%.0f identifiers recur in different reports.",
    "alerts": "Alerts of a total weight of %.1f were raised.",
    "recency": "Activity was recorded recently (%.2f, 1 is now).",
}
#: What a family without any record could change.
MISSING = {"money": "No payments are recorded; they could change the priority.", "comm": "No calls or messages are recorded; they could change the priority.", "coloc": "No meetings or places are recorded; they could change the picture."}
STATUS = {"confirmed": "An officer has confirmed this lead.", "dismissed": "An officer has dismissed this lead.", "needs_more_info": "An officer has asked for more information."}
CLOSING = "This is a priority for looking first, not a finding; verify it against the records."


def factors(rows: DataFrame) -> DataFrame:
    """actor, feature, family, value, contribution, sentence: what each feature that counts adds to the logit.

    A family above its cap is held, and its features shrink with it, so contributions add up to what the family adds (recency:
    before it is tied to the others).
    """
    r, total, held = _scaled(rows)
    shrink = {f: F.when(total[f] > 0, held[f] / total[f]).otherwise(0.0) for f in FAMILY_CAP}
    each = [F.struct(F.lit(k).alias("feature"), F.lit(fam).alias("family"), F.col(k).alias("value"), (F.lit(w) * F.col(f"s_{k}") * shrink[fam]).alias("contribution"), F.format_string(SENTENCES[k], F.col(k)).alias("sentence")) for k, fam, w, *_ in FEATURES]
    return r.select("actor", F.explode(F.array(*each)).alias("f")).select("actor", "f.*").where("contribution > 0")


def summaries(rows: DataFrame, ranked: DataFrame, reasons: int = 3) -> DataFrame:
    """actor, summary: rank, score and range, the strongest reasons, what is missing, and the officer's decision. ranked: scores()."""
    w = Window.partitionBy("actor").orderBy(F.desc("contribution"), "feature")
    top = factors(rows).where("contribution >= 0.05").withColumn("r", F.row_number().over(w)).where(F.col("r") <= reasons)
    top = top.groupBy("actor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"]), " ").alias("why"))
    gap = F.lit(None).cast("string")
    for family, text in reversed(MISSING.items()):
        gap = F.when(F.col(f"obs_{family}") == 0, text).otherwise(gap)
    j = ranked.join(top, "actor", "left").join(rows.select("actor", gap.alias("gap")), "actor")
    place = F.when(F.col("rank").isNotNull(), F.format_string("Ranked %d as a lead", F.col("rank"))).otherwise("Not ranked, by the role")
    first = F.concat(place, F.format_string(": %d of 100 (%s; %d to %d given the records).", "score", "tier", "low", "high"))
    state = F.lit(None).cast("string")
    for status, text in STATUS.items():
        state = F.when(F.col("status") == status, text).otherwise(state)
    return j.select("actor", F.concat_ws(" ", first, F.coalesce("why", F.lit("No strong signal was found.")), "gap", state, F.lit(CLOSING)).alias("summary"))


def closest(money: DataFrame, comm: DataFrame, most: int = 15) -> DataFrame:
    """actor, other, n, rank: whom each actor dealt with most; a report of the first ones."""
    e = money.select("a", "b").unionByName(comm.select("a", "b"))
    n_ = e.select(F.col("a").alias("actor"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("actor"), F.col("a").alias("other"))).groupBy("actor", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("actor").orderBy(F.desc("n"), "other")
    return n_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def quality(scored: DataFrame, truth: DataFrame, score: str = "logit") -> DataFrame:
    """auc, p_at_10, r_precision, recall_at_10 of a ranking. scored: actor, score. truth: actor. Equal scores share their ranks' mean."""
    s = scored.select("actor", F.col(score).alias("x")).join(truth.select("actor", F.lit(1).alias("hit")).distinct(), "actor", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    by = s.groupBy("x").agg(F.sum("hit").alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = by.select("pos", "n", (F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)).alias("won")).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    k = truth.distinct().count()
    order = [F.desc("x"), "actor"]
    top = s.orderBy(*order).limit(max(k, 10)).withColumn("r", F.row_number().over(Window.orderBy(*order)))
    best = top.agg(F.sum(F.when(F.col("r") <= 10, F.col("hit"))).alias("ten"), F.sum(F.when(F.col("r") <= k, F.col("hit"))).alias("k"))
    return area.crossJoin(best).select(  # one row each
        F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"), (F.col("ten") / 10).alias("p_at_10"), F.try_divide(F.col("k"), F.lit(k)).alias("r_precision"), F.try_divide("ten", F.col("pos")).alias("recall_at_10"),
    )


def ablation(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """without, and quality(): of the whole model, then with one family of features left out. Roles are not used."""
    plain = cut(rows.withColumn("role", F.lit("")))
    out = None
    for family in ("", *[f for f in FAMILY_CAP if f != "recency"]):
        less = plain.withColumns({k: F.lit(0.0) for k, fam, *_ in FEATURES if fam == family} | {f"obs_{family}": F.lit(0).cast("long")}) if family else plain
        q = quality(scores(less), truth).select(F.lit(family or "nothing").alias("without"), "*")
        out = q if out is None else out.unionByName(q)
    return out
