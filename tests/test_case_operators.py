"""Case graphs, scores, normal forms, posts, exports and movement, against brute force on small cases."""

import hashlib
import hmac
import math
import time
from collections import deque
from datetime import date
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evidentia.functions import normal as n
from evidentia.operators import anomaly, casegraph, evidence, integrity, movement, resolution, social, twins
from evidentia.sources import exports

STAR = [("H", "L1"), ("H", "L2"), ("H", "L3"), ("H", "L4"), ("L4", "L5"), ("X", "Y")]


def frame(spark, edges, case="c"):
    return spark.createDataFrame([(case, *sorted(e)) for e in edges], "case string, a string, b string")


def near(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def steps(adj, s):
    dist, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in adj[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist


def pieces(adj, gone=()):
    left, out = set(adj) - set(gone), []
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            todo += [y for y in adj[x] if y not in seen and y not in gone]
        out.append(len(seen))
        left -= seen
    return out


def shortest(adj, s, t):
    paths, todo = [], [[s]]
    while todo and not paths:
        paths = [p for p in todo if p[-1] == t]
        todo = [[*p, y] for p in todo for y in adj[p[-1]] if y not in p]
    return paths


def test_centralities(spark):
    rng = np.random.default_rng(3)
    edges = sorted({tuple(sorted((f"n{a:02}", f"n{b:02}"))) for a, b in rng.integers(0, 14, (22, 2)) if a != b}) + [("y1", "y2")]
    adj = near(edges)
    got = {r.node: r for r in casegraph.centralities(frame(spark, edges)).collect()}
    size = len(adj)
    between = dict.fromkeys(adj, 0.0)
    for s, t in combinations(sorted(adj), 2):
        ways = shortest(adj, s, t)
        for p in ways:
            for x in p[1:-1]:
                between[x] += 1 / len(ways)
    whole = len(pieces(adj))
    for x, around in adj.items():
        r, d = got[x], steps(adj, x)
        far = sum(d.values())
        links = sum(b in adj[a] for a, b in combinations(around, 2))
        assert math.isclose(r.degree, len(around) / (size - 1))
        assert math.isclose(r.betweenness, 2 * between[x] / ((size - 1) * (size - 2)), abs_tol=1e-9)
        assert math.isclose(r.closeness, (len(d) - 1) / far * (len(d) - 1) / (size - 1))
        assert math.isclose(r.clustering, 2 * links / (len(around) * (len(around) - 1)) if len(around) > 1 else 0.0)
        assert r.cut_vertex == (len(pieces(adj, [x])) > whole)
    assert math.isclose(sum(r.pagerank for r in got.values()), 1, abs_tol=1e-4)
    for k in (1, 2, 3):
        left = dict(adj)
        while weak := [x for x in left if len(left[x] & set(left)) < k]:
            left = {x: v for x, v in left.items() if x not in weak}
        assert {x for x, r in got.items() if r.core >= k} == set(left)
        assert {r.node for r in casegraph.k_core(frame(spark, edges), k).collect()} == set(left)


def test_communities_of_two_cliques(spark):
    edges = [(f"a{i}", f"a{j}") for i, j in combinations(range(7), 2)][1:] + [(f"b{i}", f"b{j}") for i, j in combinations(range(7), 2)][1:] + [("a3", "b3")]
    got = {r.node: r.community for r in casegraph.centralities(frame(spark, edges)).collect()}
    assert len({got[f"a{i}"] for i in range(7)}) == len({got[f"b{i}"] for i in range(7)}) == 1 and got["a0"] != got["b0"]
    e = casegraph.spectral(casegraph.Csr(*zip(*edges, strict=True)))
    assert np.allclose(np.linalg.norm(e, axis=1), 1)


def test_critical_nodes_and_removal(spark):
    rows = casegraph.critical_nodes(frame(spark, STAR), k=2).collect()
    assert [(r.step, r.node, r.pairs_after) for r in rows if r.kind == "articulation"] == [(1, "H", 2), (2, "L4", 7)]
    assert next(r for r in rows if r.kind == "greedy" and r.step == 1).node == "H"
    gone = spark.createDataFrame([("c", "H")], "case string, node string")
    r = casegraph.removal(frame(spark, STAR), gone).first()
    assert (r.nodes_left, r.pairs_before, r.pairs_after, r.isolated) == (7, 11, 2, 3)
    m = casegraph.metrics(frame(spark, STAR)).first()
    assert (m.nodes, m.edges, m.components, m.largest, m.diameter, m.pairs) == (8, 6, 2, 6, 3, 16)


def test_roles(spark):
    got = {r.node: r.role for r in casegraph.roles(frame(spark, STAR)).collect()}
    assert got["H"] == "Coordinator / Hub" and got["L4"] == "Courier / Intermediary" and got["L1"] == "Peripheral"


def test_hidden_paths(spark):
    p = spark.createDataFrame([("s", "m", 0.9), ("m", "t", 0.5), ("s", "k", 0.4), ("k", "t", 0.4), ("m", "k", 1.0), ("s", "t", 1.0)], "a string, b string, confidence double")
    got = [(r.path, r.confidence) for r in casegraph.hidden_paths(p, "s", "t", most=3).collect()]
    assert got == [(["s", "m", "t"], 0.7), (["s", "k", "t"], 0.4), (["s", "m", "k", "t"], 0.7667), (["s", "k", "m", "t"], 0.6333)]


def test_anomalies(spark):
    rng = np.random.default_rng(5)
    rows = [("c", f"e{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))] + [("c", "odd", 9.0, -9.0), ("few", "x", 1.0, 2.0)]
    got = {(r.case, r.entity): r for r in anomaly.anomaly_scores(spark.createDataFrame(rows, "case string, entity string, u double, v double"), ["u", "v"]).collect()}
    assert max(got.values(), key=lambda r: r.score).entity == "odd" and got["c", "odd"].severity == "High" and got["few", "x"].score == 0
    x = np.array([[0.0], [1.0], [2.0], [3.0], [30.0], [31.0]])
    k, d = 5, np.abs(x - x.T)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, order, 1)
    reach = [np.mean([max(dist[j, -1], d[i, j]) for j in order[i]]) for i in range(6)]
    assert np.allclose(anomaly.outlier_factor(x), [np.mean([reach[i] / reach[j] for j in order[i]]) for i in range(6)])


def test_pass_through_and_scores(spark):
    h = 3600
    money = [("i1", 0, "s", "m", 100.0), ("o1", 3 * h, "m", "t", 95.0), ("i2", 60 * h, "s", "m", 100.0), ("o2", 61 * h, "m", "s", 80.0), ("o3", 200 * h, "m", "t", 50.0)]
    m = spark.createDataFrame(money, "id string, t long, a string, b string, amount double")
    got = {r.actor: r.pass_through for r in evidence.pass_through(m).collect()}
    assert math.isclose(got["m"], 95 / 200 * (1 - math.exp(-1))) and math.isclose(got["t"], 0.0)
    own = evidence.owned(m.withColumn("kind", F.lit("money")), spark.createDataFrame([("s", "A"), ("s", "B"), ("m", "M"), ("t", "M")], "item string, actor string")).where("id = 'i1'").collect()
    assert sorted((r.a, r.b, r.amount) for r in own) == [("A", "M", 50.0), ("B", "M", 50.0)]
    actors = spark.createDataFrame([("s", "suspect"), ("m", None), ("t", "victim"), ("q", None)], "actor string, role string")
    empty = spark.createDataFrame([], "id string, t long, place string, actor string")
    count = spark.createDataFrame([("m", 2)], "actor string, n long")
    f = evidence.features(actors, m, m.limit(0), empty, count, count, spark.createDataFrame([("m", 0.5)], "actor string, w double"))
    r = {x.actor: x for x in f.collect()}
    assert r["m"].money_to_accused == 3 and r["m"].money_volume == 425.0 and r["q"].money_volume == 0 and r["m"].money_fan == 2
    s = {x.actor: x for x in evidence.scores(f, spark.createDataFrame([("q", "confirmed_person_of_interest"), ("s", "dismissed")], "actor string, decision string")).collect()}
    assert s["t"].rank is None and (s["q"].rank, s["m"].rank, s["s"].rank) == (1, 2, 3)
    assert math.isclose(s["q"].logit, evidence.BIAS) and s["m"].low < s["m"].score < s["m"].high


def test_resolution_equals_brute_force(spark):
    names = ["Rahul Sharma", "Rahul Sharme", "R Sharma", "Priya Nair", "Sharma Rahul Traders", "Zed"]
    records = spark.createDataFrame([(f"r{i}", x, ["98765"] if i == 3 else []) for i, x in enumerate(names)], "id string, name string, identifiers array<string>")
    asked = spark.createDataFrame([("q1", "rahul  sharma"), ("q2", "987-65")], "query string, value string")
    got = {(r.query, r.id): r for r in resolution.candidates(asked, records).collect()}

    def grams(t):
        return [f" {w} "[i : i + k] for w in t.split() for k in range(2, 6) for i in range(len(w) + 2 - k + 1)]

    texts = [" ".join(x.lower().split()) + (" 98765" if i == 3 else "") for i, x in enumerate(names)]
    df = {}
    for t in texts:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1

    def vector(t):
        count = {}
        for g in grams(t):
            count[g] = count.get(g, 0) + 1
        v = {g: (1 + math.log(c)) * (math.log(7 / (1 + df[g])) + 1) for g, c in count.items() if g in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    q = vector("rahul sharma")
    for i in (0, 1, 4):
        v = vector(texts[i])
        cosine = sum(x * v.get(g, 0) for g, x in q.items())
        lexical = SequenceMatcher(None, "rahul sharma", " ".join(names[i].lower().split())).ratio()
        score = round(min(1, 0.52 * cosine + 0.28 * lexical), 4)
        if score >= 0.6:
            assert math.isclose(got["q1", f"r{i}"].score, score, abs_tol=2e-4)
        else:
            assert ("q1", f"r{i}") not in got
    assert got["q2", "r3"].score >= 0.93 and got["q2", "r3"].band == "high"


def test_normal_forms(spark):
    d = spark.createDataFrame([("०१२", "+91 98765-43210", "236145678903", "Shri Rám  Lal"), (None, "12", "236145678904", None)], "d string, p string, v string, n string")
    a, b = d.select(n.ascii_digits(F.col("d")), n.mobile(F.col("p")), n.verhoeff_ok(F.col("v")), n.person_key(F.col("n")), F.array_join(n.name_tokens(F.col("n")), " ")).collect()
    assert a[0] == "012" and a[1] == "9876543210" and a[3] == "rám lal" and a[4] == "lal ram" and b[1] == "" and b[3] == ""
    product, powers = n._verhoeff()
    ok = lambda t: __import__("functools").reduce(lambda c, x: product[c * 10 + powers[(x[0] % 8) * 10 + int(x[1])]], enumerate(reversed(t)), 0) == 0
    valid = [f"23614567890{k}" for k in range(10) if ok(f"23614567890{k}")]
    assert len(valid) == 1 and not ok(valid[0][:5] + valid[0][6] + valid[0][5] + valid[0][7:])  # a swap is found
    assert [r[0] for r in spark.createDataFrame([(valid[0],), (valid[0][:-1],)], "v string").select(n.verhoeff_ok(F.col("v"))).collect()] == [True, False]
    w = spark.createDataFrame([("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb",), ("0x" + "ab" * 20,), (None,)], "a string")
    assert [r[0] for r in w.select(n.wallet_chain(F.col("a"))).collect()] == ["Bitcoin", None, "Ethereum-style (0x)", None]
    m = spark.createDataFrame([("Mohammad Ali", "Ali Mohamad", True), ("A B", "A C", False), ("Ann", "Anne", False), ("X Y", "y x", True)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in m.withColumn("got", n.names_match(F.col("a"), F.col("b"))).collect())
    r = spark.createDataFrame([("Accused No. 1", "accused"), ("unknown suspect", ""), ("FATHER_OF complainant", "complainant_relative"), ("Suspect", "suspect"), ("informant", "complainant"), (None, "")], "t string, want string")
    assert all(x.got == x.want for x in r.withColumn("got", n.role_class(F.col("t"))).collect())
    q = spark.createDataFrame([("maaaaar “x”​  y",)], "t string").select(n.plain_quotes(F.col("t"))).first()[0]
    assert q == 'maar "x" y'
    p = spark.createDataFrame([("03/02/2024", date(2024, 2, 3)), ("2024-02-03T10:00", date(2024, 2, 3)), ("31/02/2024", None), ("x", None)], "t string, want date")
    assert all(x.got == x.want for x in p.withColumn("got", n.parse_day(F.col("t"))).collect())


def test_lookalikes_and_caps(spark):
    bio = "official page about cricket news daily updates"
    acc = [("1", "x", "rahul_sharma92", "Rahul Sharma", bio), ("2", "y", "R4hul.sharma", "rahul sharma", bio), ("3", "x", "rahulsharna", "Other Name", ""), ("4", "x", "someone", "Another", None)]
    got = {(r.a, r.b): (r.score, r.strength) for r in social.lookalikes(spark.createDataFrame(acc, "key string, platform string, handle string, name string, bio string")).collect()}
    assert got == {("1", "2"): (1.0, "strong")}
    p = spark.createDataFrame([("a", "flags", 50.0), ("a", "flags", 50.0), ("a", "watch", 10.0), ("b", "watch", 20.0)], "account string, part string, points double")
    assert {(r.account, r.points, r.level) for r in social.capped(p, {"flags": 60, "watch": 45}).collect()} == {("a", 70.0, "high"), ("b", 20.0, "low")}
    x = social.extracted(spark.createDataFrame([(1, "Hi @Bob and @bob: #Tag http://A.com/X/ me@x.org +91 98765 43210")], "uid long, text string")).first()
    assert (x.mentions, x.tags, x.urls, x.emails, x.phones) == (["bob"], ["tag"], ["a.com/x"], ["me@x.org"], ["9876543210"])
    assert social.interactions(social.extracted(spark.createDataFrame([(1, "s", "@bob @s")], "uid long, account string, text string")), spark.createDataFrame([("bob", "b"), ("s", "s")], "handle string, account string")).collect()[0][:] == ("s", "b", 1)


def test_keyed_hash_and_logs(spark):
    d = spark.createDataFrame([("text",)], "t string")
    for key in (b"k", b"x" * 80):
        assert d.select(integrity.keyed_hash(key, F.col("t"))).first()[0] == hmac.new(key, b"text", hashlib.sha256).hexdigest()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows, prev = [], "head"
    for k in (1, 2, 3, 4):
        now = sha(prev + f"c{k}")
        rows.append(["log", k, f"u{k}", prev, now, "u9" if k == 2 else "u4" if k == 3 else None, f"c{k}"])
        prev = now

    def find(rows, head=prev, count=4):
        e = spark.createDataFrame(rows, "log string, seq long, uid string, prev string, digest string, supersedes string, body string")
        h = spark.createDataFrame([("log", "head", head, count)], "log string, header string, head string, count long")
        return sorted((r.seq, r.problem) for r in integrity.log_problems(h, e, F.col("body")).collect())

    amend = [(2, "bad_amendment_link"), (3, "bad_amendment_link")]
    assert find(rows) == amend
    assert find([[*r[:6], "edited"] if r[1] == 4 else r for r in rows]) == [*amend, (4, "content_changed")]
    assert find(rows[:3]) == sorted([(2, "bad_amendment_link"), (3, "bad_amendment_link"), (3, "count_mismatch"), (3, "head_mismatch")])
    live, rec = (spark.createDataFrame(x, "id long, digest string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x"), (4, "d")]))
    assert {(r.id, r.problem) for r in integrity.row_check(live, rec, ["id"]).collect()} == {(2, "modified"), (3, "unrecorded"), (4, "missing")}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, "C;1", "a, b", "line\nnext " + "é" * 60, date(2024, 2, 28))], "id long, case_number string, label string, note string, due date")
    ics = exports.calendar_events(d).first().ics
    assert "DTEND;VALUE=DATE:20240229" in ics and "SUMMARY:[C\\;1] a\\, b" in ics and "DESCRIPTION:line\\nnext" in ics
    assert all(len(x.encode()) <= 75 for x in ics.split("\r\n")) and ics.replace("\r\n ", "").count("é") == 60
    docs = spark.createDataFrame([("a@x.org b@x.org 9876543210",), ("A@x.org",)], "text string")
    one, two = ({(r.kind, r.value): r.label for r in exports.labels(docs, s).collect()} for s in (b"1", b"1"))
    assert one == two and sorted(v for (k, _), v in one.items() if k == "email") == ["EMAIL-001", "EMAIL-002"]
    order = sorted(["a@x.org", "b@x.org"], key=lambda v: hmac.new(b"1", f"email|{v}".encode(), hashlib.sha256).digest())
    assert one["email", order[0]] == "EMAIL-001"
    exports.write_csv(spark.createDataFrame([("=1+1", "x")], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()[:] == ("'=1+1", "x")


def test_stays_and_places(spark):
    rows = [("s", 1, 0, 10.0, 20.0), ("s", 2, 600, 10.001, 20.0), ("s", 3, 7200, 11.0, 20.0), ("s", 4, 9000, 10.0, 20.001), ("s", 5, 9600, None, None)]
    d = spark.createDataFrame([(*r, 11.0 if r[1] == 5 else None, 20.0 if r[1] == 5 else None) for r in rows], "key string, seq long, t long, lat double, lon double, place_lat double, place_lon double")
    p = movement.points(d)
    assert [r.precision for r in p.orderBy("seq").collect()] == ["recorded"] * 4 + ["approximate"]
    got = [(r.place, r.visits, r.points, r.dwell_s) for r in movement.stays(p).orderBy("place").collect()]
    assert got == [(1, 2, 3, 600), (2, 2, 2, 0)]


def test_closeness_and_cores_of_many_nodes():
    """Two stars of stars and a pair; walking from every node in turn takes minutes."""
    k, edges = 120, [("x", "y")]
    for s in "ab":
        edges += [(f"{s}{i}", s) for i in range(k)] + [(f"{s}{i}-{j}", f"{s}{i}") for i in range(k) for j in range(k)]
    g, began = casegraph.Csr(*zip(*edges, strict=True)), time.process_time()
    got, cores = dict(zip(g.names, casegraph.closeness(g), strict=True)), casegraph.core_numbers(g)
    assert time.process_time() - began < 5
    n, size = k + k * k, g.n
    assert size > 29000 and math.isclose(got["a"], n / (k + 2 * k * k) * n / (size - 1)) and math.isclose(got["x"], 1 / (size - 1))
    far = 1 + k + 2 * (k - 1) + 3 * (k - 1) * k
    assert math.isclose(got["b7"], n / far * n / (size - 1)) and math.isclose(got["b7-3"], n / (far + n - 1) * n / (size - 1))
    assert (cores == 1).all()


def test_measures_asked_for(spark):
    got = casegraph.centralities(frame(spark, STAR), ("core", "cut_vertex"))
    assert got.columns == ["case", "node", "core", "cut_vertex"] and {r.node for r in got.collect() if r.cut_vertex} == {"H", "L4"}


def test_counts_of_records_build_no_network(spark, data, monkeypatch):
    from evidentia.plans import scores

    def never(*_):
        raise AssertionError("the network was built")

    monkeypatch.setattr(casegraph, "centralities", never)
    monkeypatch.setattr(evidence, "copresence", never)
    assert scores.evidence_counts(spark, data).count() > 0


def test_network_features_ask_for_four_measures(spark, data, monkeypatch):
    from evidentia.plans import scores

    asked, whole = [], casegraph.centralities
    monkeypatch.setattr(casegraph, "centralities", lambda e, only=(): asked.append(set(only)) or whole(e))
    scores.evidence_features(spark, data)
    assert asked == [{"pagerank", "betweenness", "core", "community"}]


def test_resolution_sends_no_exploded_rows_to_all_tasks(spark, monkeypatch):
    """Spark estimates that the n-grams of all records are as small as the records, and would broadcast them."""
    records = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("steel ring "), F.col("id") % 7).alias("name"), F.array(F.concat(F.lit("P"), "id")).alias("identifiers"))
    asked = spark.createDataFrame([("ring 3", "ring 3"), ("P12", "P12"), ("none", "...")], "query string, value string")
    got = resolution.candidates(asked, records)
    rows = sorted(map(tuple, got.collect()))
    assert {r[1] for r in rows if r[0] == "P12"} == {"12"}

    sent = []

    def walk(plan):
        if "BroadcastExchange" in plan.nodeName():
            sent.append(plan.metrics().apply("numOutputRows").value())
        if "Adaptive" in plan.nodeName():
            walk(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            walk(plan.plan())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(got._jdf.queryExecution().executedPlan())
    assert max(sent, default=0) <= 100
    monkeypatch.setattr(resolution, "BROADCAST", 0)
    assert sorted(map(tuple, resolution.candidates(asked, records).collect())) == rows


def test_measures_with_twins_equal_those_of_the_whole_graph(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(2, 8))
        members = [sorted(f"n{x:06}" for x in rng.choice(10**6, int(rng.integers(1, 5)), replace=False)) for _ in range(k)]
        pairs = [(i, j) for i, j in combinations(range(k), 2) if rng.random() < 0.4] + [(i, i) for i in range(k) if rng.random() < 0.5 and len(members[i]) > 1]
        edges = [(a, b) for i, j in pairs for a in members[i] for b in members[j] if i != j or a < b]
        if not edges:
            continue
        g = casegraph.Csr(*zip(*edges, strict=True))
        more = [(m[0], x) for m in members for x in m[1:]]
        t = twins.Twins([members[i][0] for i, _ in pairs], [members[j][0] for _, j in pairs], [a for a, _ in more], [b for _, b in more])
        assert t.names == g.names and (t.degree == g.degree).all() and {tuple(sorted(p)) for p in zip(*t.pairs(), strict=True)} == {tuple(sorted(p)) for p in edges}
        assert np.allclose(twins.pagerank(t), casegraph.pagerank(g)) and (twins.core_numbers(t) == casegraph.core_numbers(g)).all()
        want = casegraph.louvain(g)
        monkeypatch.setattr(casegraph, "TIDY", 2)
        assert (casegraph.louvain(t) == want).all() and (casegraph.louvain(g) == want).all()
        monkeypatch.setattr(casegraph, "TIDY", 4096)
        for way in (twins._by_matrix, twins._by_lists):
            monkeypatch.setattr(twins._Part, "shares", way)
            assert np.allclose(twins.betweenness(t), casegraph.betweenness(g), atol=1e-12)


def test_evidence_takes_betweenness_from_all_nodes(spark, monkeypatch):
    """Above MANY nodes, a share of the sources is drawn elsewhere; here no size may change a result."""
    calls = [(str(i), i * 10**6, f"p{a:02}", f"p{b:02}", 1.0) for i, (a, b) in enumerate(np.random.default_rng(5).integers(0, 30, (45, 2)).tolist()) if a != b]
    comm = spark.createDataFrame(calls, "id string, t long, a string, b string, amount double")
    actors = comm.select(F.explode(F.array("a", "b")).alias("actor")).distinct().withColumn("role", F.lit(None).cast("string"))
    none, count = spark.createDataFrame([], "id string, t long, place string, actor string"), spark.createDataFrame([], "actor string, n long")
    g = casegraph.Csr(*zip(*{tuple(sorted(c[2:4])) for c in calls}, strict=True))
    want = dict(zip(g.names, casegraph.betweenness(g), strict=True))
    monkeypatch.setattr(casegraph, "MANY", 10)
    monkeypatch.setattr(casegraph, "PIVOTS", 5)
    got = {r.actor: r.betweenness for r in evidence.features(actors, comm.limit(0), comm, none, count, count, spark.createDataFrame([], "actor string, w double")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def test_copies_of_actors_add_no_pairs(spark, data, monkeypatch):
    """Sixty actors at one place at one time are one class: two of them meet, not all."""
    asked, whole = [], evidence.copresence
    monkeypatch.setattr(evidence, "copresence", lambda p, o=None: asked.append((p.count(), o.count())) or whole(p, o))
    stays = [(f"i{i}", 0, "here", f"c{i:02}") for i in range(60)] + [("j", 3600, "here", "d")]
    places = spark.createDataFrame(stays, "id string, t long, place string, actor string")
    actors = places.select("actor", F.when(F.col("actor").isin("c03", "d"), "suspect").alias("role"))
    none, count = spark.createDataFrame([], "id string, t long, a string, b string, amount double"), spark.createDataFrame([], "actor string, n long")
    got = {r.actor: r for r in evidence.features(actors, none, none, places, count, count, spark.createDataFrame([], "actor string, w double")).collect()}
    assert asked == [(2, 3)] and all((r.copresence, r.degree, r.obs_coloc, r.kcore) == (60, 60, 60, 60) for r in got.values())
    assert {a: r.meet_accused for a, r in got.items() if a in ("c00", "c03", "d")} == {"c00": 2, "c03": 1, "d": 1}
