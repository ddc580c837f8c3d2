"""The fast forms of models and packing against plain ones; clashing columns; every pipeline stage on odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import common, language, licenses, packing, pieces, secrets, toxicity
from evidentia.llm import textbytes as tb

from .test_operators import ODD, SCHEMA

TEXTS = ["One two three two one", "", "a", "the cat sat on the mat, the cat!", "x " * 50, "naïve café 12 été"]


def test_tables_equal_plain_convolutions():
    rng = np.random.default_rng(1)
    f = [rng.normal(size=(w * 4, 5)) for w in language.WIDTHS]
    m = language.ByteCnn(["a", "b", "c"], rng.normal(size=(256, 4)), f, rng.normal(size=15), rng.normal(size=(15, 3)), rng.normal(size=3))
    rows, _, size = language.cut_windows(*tb.flat(pa.array(["some text " * 30, "b", "ü" * 100])))
    assert size.sum() == 300 + 1 + 200
    got = m.window_probabilities(rows, m.tables())
    for r, p in zip(rows, got, strict=True):
        e, peaks = m.embed[r], []
        for w, k in zip(language.WIDTHS, f, strict=True):
            peaks += (np.array([e[i : i + w].ravel() @ k for i in range(len(r) - w + 1)]).max(0)).tolist()
        z = np.exp(np.maximum(np.array(peaks) + m.bias, 0) @ m.dense + m.offset)
        assert np.allclose(p, z / z.sum(), atol=1e-4)


def test_sums_of_weights_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    model = toxicity.Weights(0.25, np.arange(1 << toxicity.BITS, dtype=np.int32), w)

    def bucket(words):
        data, off = tb.flat(pa.array([" ".join(words)]))
        h = tb.span_hashes(tb.LOWER[data], *tb.words(tb.LOWER[data], off, tb.NON_WORD)[:2])
        out = set(h.tolist())
        for gap, salt in ((1, toxicity._PAIR), (2, toxicity._SKIP)):
            out |= {int(tb.mix(np.array([h[i] * salt + h[i + gap]], tb.U))[0]) for i in range(len(h) - gap)}
        return {x & (1 << toxicity.BITS) - 1 for x in out}

    d = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r[0] for r in d.select(toxicity.scorer(spark, model)(F.col("text"))).collect()]
    for t, p in zip(TEXTS, got, strict=True):
        words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t)
        total = 0.25 + sum(float(w[b]) for b in bucket(words)) if words else 0.25
        assert p == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4)


def test_settings_come_from_the_sample_alone():
    rng = np.random.default_rng(4)
    rows = [np.unique(np.append(rng.integers(0, 1000, 30), 5000 + i % 2)).astype(np.int32) for i in range(200)]
    target = np.array([i % 2 for i in range(200)], float)
    s = toxicity.choose(rows, target)
    assert s == toxicity.choose(rows, target) and (s["alpha"], s["l1"]) in toxicity.GRID
    m = toxicity.ftrl(rows, target, **s).dense()
    assert m[5001] > 0 > m[5000]


def test_best_fit_equals_a_scan_of_all_bins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 120
        size = sorted(rng.integers(0, 60, n).tolist(), reverse=True)
        source, cluster = [None if x == 7 else int(x) for x in rng.integers(0, 8, n)], [None if x == 19 else int(x) for x in rng.integers(0, 20, n)]
        bins: list[list] = []
        want = []
        for i in range(n):
            fits = [(100 - sum(size[j] for j in b) - size[i], k) for k, b in enumerate(bins) if sum(size[j] for j in b) + size[i] <= 100 and not any(source[i] is not None and source[j] == source[i] or cluster[i] is not None and cluster[j] == cluster[i] for j in b)]
            k = min(fits)[1] if fits else len(bins)
            if k == len(bins):
                bins.append([])
            bins[k].append(i)
            want.append(k)
        assert packing.best_fit(size, source, cluster, 100) == want


def test_ngrams_equal_plain_ones():
    data, off = tb.flat(pa.array(TEXTS))
    bucket, owner, n, word = licenses.grams(data, off)
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
        runs = [(" ".join(words[j : j + k]), k) for k in (1, 2, 3) for j in range(len(words) - k + 1)]
        assert (owner == i).sum() == len(runs)
        own = [b for b, o in zip(bucket.tolist(), owner, strict=True) if o == i]
        assert len(set(own)) == len(set(runs))  # equal runs share a bucket, others don't


def test_unknown_class_sees_lines_that_name_licences():
    sample = [f"the licence of the driver number {i} was revoked under the general terms" for i in range(40)]
    m = licenses.fit([*sample, "released under the mit license"])
    own = licenses._sets([sample[0]])[0][0]
    assert m.classify(own)[0] == licenses.UNKNOWN and m.classify(licenses._sets(["released under the mit license"])[0][0])[0] == "mit"


def test_long_runs_of_marks_equal_the_model():
    import sentencepiece
    from pathlib import Path

    p, sp = pieces.Pieces(Path(pieces.MODEL).read_bytes()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in ("a" + " " * 5000 + "b", " " * 333, "x   y  z \n\n   " + "  foo" * 9):
        assert np.frombuffer(p.encode([t])[0], np.int32).tolist() == sp.encode(t)


def test_pieces_learn_each_word_once_and_tell_the_round_trip(spark, monkeypatch):
    """Frequent words outlast a full cache, the next task goes on with the worker's model, the round trip is that of decoding."""
    import sentencepiece
    from pathlib import Path

    data = Path(pieces.MODEL).read_bytes()
    p, sp = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    learned, learn = [], p.learn
    monkeypatch.setattr(p, "learn", lambda words: (learned.extend(words), learn(words)))
    monkeypatch.setattr(pieces, "CACHE", 40)
    texts = [["the rest of it " + " ".join(f"w{i}x{j}" for j in range(9)), None, "", "▁a \ufb01 \x00b", "a  b", "\U0001f600ré"] for i in range(12)]
    for some in texts:
        ids, same = p.read(some)
        ids = [np.frombuffer(x, np.int32).tolist() for x in ids]
        assert ids == [sp.encode(t or "") for t in some]
        assert same == [t is None or p.decode(x) == t for t, x in zip(some, ids, strict=True)] and set(same) == {True, False}
        assert len(p.cache) + len(p.older) <= 40
    assert learned.count("▁the") == 1 and len(learned) == len(set(learned))
    assert pieces._reader(spark, pieces.MODEL)() is pieces._reader(spark, pieces.MODEL)()


CLASH = ("live", "_d", "_key", "_out", "_live", "_hash", "_id", "_h", "_draw", "value", "owner")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(*r, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASH))


def test_clashing_columns(spark, clashing, data):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, data)
        assert got.columns == clashing.columns, name
        left = {tuple(r[-len(CLASH) :]) for r in got.collect()}
        assert left <= {tuple(r[-len(CLASH) :]) for r in clashing.collect()}, name
    out = secrets.redact(clashing)
    assert out.count() == clashing.count() and sorted(r.live for r in out.collect()) == sorted(r.live for r in clashing.collect())
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {'no id here at all, token = "[SECRET]"'}


def test_stages_on_odd_rows(spark, clashing, data):
    import corpus_pipeline

    kept = [stage(spark, clashing, data) for _, stage in corpus_pipeline.STAGES]
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in k.collect()) for k in kept]
    assert all(r.text for r in kept[0].collect())  # texts without a letter go
    assert len(ids[1]) == len(ODD)  # no labelled row is among them: nothing is toxic
    near = [i for _, i in ids[2]]
    assert 4 not in near and near.count(3) == 1 and (True, 0) in ids[2] and {1, 2, 5, 6} <= set(near)
    assert len(ids[3]) == len(ODD) and len(ids[4]) >= len(ODD)
    empty = clashing.limit(0)
    assert all(stage(spark, empty, data).isEmpty() for _, stage in corpus_pipeline.STAGES)


def test_a_repeated_id_neither_fills_nor_empties_the_sample(spark):
    rows = [(1, "same", "x")] * 5000 + [(i, f"text {i}", "x") for i in range(100, 200)] + [(i, f"text {i}", "y") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = common.bounded_sample(d, "lang", F.xxhash64("doc_id", "text"), 50).collect()
    x = [r for r in got if r.lang == "x"]
    assert 20 <= len(x) <= 90 and len({(r.doc_id, r.text) for r in x}) == len(x) and sum(r.lang == "y" for r in got) == 30


def test_language_stage_rejects_what_is_no_language(spark, data):
    """Shuffled texts and texts of a language that was not learned go, learned ones stay, however few languages there are."""
    import random

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("octet_length(text) >= 300")
    some = random.Random(3)
    junk = [(-1 - i, "".join(some.sample(r.text, len(r.text)))) for i, r in enumerate(docs.select("text").limit(100).collect())]
    kept = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))).unionByName(spark.createDataFrame(junk, "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id for r in corpus_pipeline.language_stage(spark, kept, data).select("doc_id").collect()}
    known = {r.doc_id for r in docs.where("lang <> 'es'").select("doc_id").collect()}
    other = {r.doc_id for r in docs.where("lang = 'es'").select("doc_id").collect()}
    assert not [d for d in got if d < 0]
    assert len(known & got) >= 0.995 * len(known) and len(other & got) <= 0.1 * len(other)
