"""Licence families of the paragraphs of whole texts.

A softmax regression over sparse word n-grams (one to three words) is trained on the templates below, on fragments of
them, and on a bounded sample of the corpus's own lines as the unknown class: a line, at any place, of each of SAMPLE texts
drawn by hash, without those that hold a template. The unknown class is calibrated: the least probability that names a
family is the one that at most one in a thousand of the sampled lines that training left out exceeds, LEAST_PROBABILITY at
least; with fewer than a thousand such lines it is the largest of theirs. A named family counts only if one of its templates is found in the paragraph: CONTAINED of the
template's n-grams of two and three words.

Each line is looked at, and then each passage of lines without an empty one between them (a line without a word is empty):
where CONTAINED of a template lies within SPREAD times its words, across any line ends, the words from the first to the last
of its n-grams there are a wrapped notice, and classified like a line. It counts, once for a family and passage, if no line
of the passage has that family already. n_paragraphs counts lines with a notice and wrapped notices. Null and empty texts have no licence. Repeated rows each get their result; ties between families go
to the alphabetically first; very long texts cost time in proportion to their length; an empty table gives no rows; other
columns of the input may have any names. Only paragraphs that share n-grams with a template are looked at closely, so cost is that of
hashing the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

BITS, LEAST_PROBABILITY, CONTAINED, SPREAD = 18, 0.6, 0.75, 1.5
#: Sampled texts, and how many of their lines train the unknown class; the others calibrate it.
SAMPLE, TRAIN = 4000, 1000
_SALTS = (tb.U(0x9E3779B97F4A7C15), tb.U(0xC2B2AE3D27D4EB4F))
# Customary notices, after the public licences.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "licensed under the bsd 3 clause license"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "proprietary": ["all rights reserved no part of this work may be reproduced without prior written permission"],
}
UNKNOWN = "unknown"


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, paragraph, length in words and first word of each n-gram."""
    low = tb.LOWER[data]
    starts, ends, owner = tb.words(low, off, tb.NON_WORD)
    h = tb.span_hashes(low, starts, ends)
    out, run = [(h, owner, 1, np.arange(len(h)))], h
    for n, salt in enumerate(_SALTS, 1):
        if len(h) <= n:
            break
        same = owner[:-n] == owner[n:]
        run = tb.mix(run[: len(h) - n] * salt + h[n:])
        out.append((run[same], owner[:-n][same], n + 1, np.flatnonzero(same)))
    return tuple(np.concatenate(c) for c in ([(x & tb.U((1 << BITS) - 1)).astype(np.int64) for x, *_ in out], [o for _, o, _, _ in out], [np.full(len(x), n) for x, _, n, _ in out], [w for *_, w in out]))


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines, and the text of each."""
    cuts = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts <= len(data)]
    return cuts, np.searchsorted(off, cuts[:-1], "right") - 1


def passages(data: np.ndarray, cuts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each line (its offsets, and its text) the passage it belongs to; lines without a word end one."""
    full = np.zeros(len(text), bool)
    full[tb.words(tb.LOWER[data], cuts, tb.NON_WORD)[2]] = True
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | ~full[1:] | ~full[:-1]
    return np.cumsum(fresh) - 1


def _sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets, and those of two and three words."""
    data, off = tb.flat(pa.array(texts, pa.string()))
    bucket, owner, n, _ = grams(data, off)
    order = np.argsort(owner, kind="stable")
    bucket, n, edge = bucket[order], n[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [(np.unique(bucket[a:b]), np.unique(bucket[a:b][n[a:b] > 1])) for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Model:
    def __init__(self, known: list[str], weights: np.ndarray, bias: np.ndarray):
        """known: corpus paragraphs for calibration are set by fit()."""
        self.classes, self.weights, self.bias, self.least = known, weights, bias, LEAST_PROBABILITY
        self.templates = [(f, _sets([t])[0][1]) for f, ts in TEMPLATES.items() for t in ts]
        self.active = np.zeros(1 << BITS, bool)
        for _, t in self.templates:
            self.active[t] = True
        self.grams = np.concatenate([t for _, t in self.templates])
        self.of = np.repeat(np.arange(len(self.templates)), [len(t) for _, t in self.templates])
        self.enough = np.array([CONTAINED * len(t) for _, t in self.templates])
        self.reach = [int(SPREAD * len(t.split())) for ts in TEMPLATES.values() for t in ts]

    def classify(self, own: np.ndarray) -> tuple[str, float]:
        z = self.weights[own].sum(0) + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.classes[k], float(p[k])

    def confirmed(self, family: str, own: np.ndarray) -> bool:
        return any(f == family and np.isin(t, own).mean() >= CONTAINED for f, t in self.templates)

    def wrapped(self, bucket: np.ndarray, n: np.ndarray, word: np.ndarray, known: set[str]) -> dict[str, float]:
        """Families beside the known ones, and their probabilities, of notices in the n-grams of a passage."""
        order = np.argsort(word, kind="stable")
        bucket, n, word = bucket[order], n[order], word[order]
        pair, found = n > 1, {}
        there = np.bincount(self.of[np.isin(self.grams, bucket[pair])], minlength=len(self.enough)) >= self.enough
        for k in np.flatnonzero(there):
            family, t = self.templates[k]
            if family in known:
                continue
            at = np.flatnonzero(pair & np.isin(bucket, t))
            place, end = word[at], word[at] + n[at]
            for i, j in enumerate(np.searchsorted(place, place + self.reach[k])):
                if j - i < self.enough[k] or i and place[i] == place[i - 1] or len(np.unique(bucket[at[i:j]])) < self.enough[k]:
                    continue
                last = end[i:j].max()
                near = slice(*np.searchsorted(word, [place[i], last]))
                own = np.unique(bucket[near][word[near] + n[near] <= last])
                got, p = self.classify(own[self.active[own]])
                if got == family and p >= self.least and self.confirmed(family, own):
                    found[family] = max(p, found.get(family, 0.0))
                    break
        return found


def fit(sample: list[str], *, epochs: int = 60, rate: float = 0.5, l2: float = 1e-4, seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    texts, target = [], []
    for family, lines in TEMPLATES.items():
        for line in lines:
            w = line.split()
            texts += [line, f"this file is {line} see the notice", f"notice {line}"] + [" ".join(x for x in w if rng.random() > 0.1) for _ in range(4)]
            target += [classes.index(family)] * 7
            texts += [" ".join(rng.permutation(w)), " ".join(w[: max(2, len(w) // 3)])]  # a few common words are no notice
            target += [classes.index(UNKNOWN)] * 2
    notices = [t for _, t in _sets([line for lines in TEMPLATES.values() for line in lines])]
    sample = [line for line, (_, own) in zip(sample, _sets(sample), strict=True) if not any(np.isin(t, own).mean() >= CONTAINED for t in notices)]
    used, held = sample[:TRAIN], sample[TRAIN:]
    texts += used
    target += [classes.index(UNKNOWN)] * len(used)
    rows, y = [s[0] for s in _sets(texts)], np.array(target)
    weights, bias = np.zeros((1 << BITS, len(classes)), np.float32), np.zeros(len(classes))
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            z = weights[rows[i]].sum(0) + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = rate / (1 + epoch / 10) / np.sqrt(1 + len(rows[i]))
            weights[rows[i]] -= step * (p + l2 * weights[rows[i]])
            bias -= 0.1 * step * p
    model = Model(classes, weights, bias)
    wrong = sorted(p if k != UNKNOWN else 0.0 for k, p in (model.classify(s[0]) for s in _sets(held) if len(s[0])) )
    if wrong:
        model.least = max(LEAST_PROBABILITY, wrong[-1 - len(wrong) // 1000])
    return model


def corpus_sample(docs: DataFrame, texts: int = SAMPLE, length: int = 400) -> list[str]:
    """A line of each of a bounded number of texts, both drawn by hash; only for training and calibrating the unknown class."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    draw = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(5))
    share = min(1.0, 2 * texts / max(1, docs.count()))
    drawn = docs.select(draw.alias("h"), "text").where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    line = F.get(lines, F.pmod(F.xxhash64("h"), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    drawn = drawn.select("h", F.substring(line, 1, length).alias("line")).where(F.length("line") > 0)
    return [r[1] for r in drawn.orderBy("h", "line").limit(texts).collect()]


def looked(m: Model, bucket: np.ndarray, owner: np.ndarray, n: np.ndarray, word: np.ndarray, count: int):
    """Each of count owners that shares n-grams with a template, and its bucket, n and word."""
    hits = np.bincount(owner[m.active[bucket] & (n > 1)], minlength=count)
    look = np.flatnonzero(hits >= 3)
    chosen = np.isin(owner, look)
    columns, owner = [c[chosen] for c in (bucket, n, word)], owner[chosen]
    order = np.argsort(owner, kind="stable")
    columns, owner = [c[order] for c in columns], owner[order]
    edge = np.searchsorted(owner, [*look, count])
    for i, k in enumerate(look):
        yield int(k), *(c[edge[i] : edge[i + 1]] for c in columns)


def op6_licenses(spark, docs: DataFrame) -> DataFrame:
    """doc_id, licenses (families in order, comma-joined), n_paragraphs, confidence (largest probability; 0 if none)."""
    shared = spark.sparkContext.broadcast(fit(corpus_sample(docs)))

    @F.arrow_udf("licenses string, n_paragraphs long, confidence double")
    def scan(texts: pa.Array) -> pa.Array:
        m = shared.value
        data, off = tb.flat(texts)
        found = [[] for _ in range(len(texts))]
        for a, b in tb.chunks(off):
            part = data[off[a] : off[b]]
            cuts, text = paragraphs(part, off[a : b + 1] - off[a])
            bucket, owner, n, _ = grams(part, cuts)
            passage = passages(part, cuts, text)
            named = {}
            for line, own, *_ in looked(m, bucket, owner, n, n, len(text)):
                own = np.unique(own)
                near = own[m.active[own]]  # other words of a long line say nothing about its notice
                family, p = m.classify(near)
                if family != UNKNOWN and p >= m.least and m.confirmed(family, own):
                    found[a + text[line]].append((family, p))
                    named.setdefault(passage[line], set()).add(family)
            head = np.flatnonzero(np.diff(passage, prepend=-1))
            for k, *own in looked(m, *grams(part, np.append(cuts[head], cuts[-1])), len(head)) if len(head) else ():
                found[a + text[head[k]]] += m.wrapped(*own, named.get(k, set())).items()
        rows = [(",".join(sorted({f for f, _ in x})), len(x), max((p for _, p in x), default=0.0)) for x in found]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["licenses", "n_paragraphs", "confidence"])

    return docs.select("doc_id", scan(F.coalesce("text", F.lit(""))).alias("_l")).select("doc_id", "_l.licenses", "_l.n_paragraphs", "_l.confidence")
