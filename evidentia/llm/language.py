"""Language of whole texts by a small convolutional network over bytes.

The network embeds bytes, slides filters of two, three and four bytes over windows of fixed length, keeps each filter's
maximum and applies a softmax layer. It is trained with numpy on a bounded sample of labelled texts. Applying it needs
no multiplication for the filters: each filter's answer to a pair of bytes is a table entry, so a window costs a few
table reads a byte. A text's prediction is the mean over all its windows, weighted by their bytes.

Nulls, texts without a letter: `und`, score 0. Labels that are null take no part in training; with no labelled text at
all, every text is `und`. Ties go to the alphabetically first language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded_sample, id_crc

WINDOW = 128
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteCnn:
    classes: list[str]
    embed: np.ndarray  # [256, E]
    filters: list[np.ndarray]  # for each width [width * E, F]
    bias: np.ndarray  # [filters]
    dense: np.ndarray  # [filters, classes]
    offset: np.ndarray  # [classes]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, the filters' sums over its pairs of bytes and, if one is left, over single bytes."""
        e, out = self.embed.shape[1], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embed @ f[i * e : (i + 1) * e]).astype(np.float32) for i in range(w)]
            pairs = [(single[i][:, None] + single[i + 1][None]).reshape(65536, -1) for i in range(0, w - 1, 2)]
            out.append(pairs + [single[-1]] * (w % 2))
        return out

    def window_probabilities(self, rows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pair = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
        best = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = rows.shape[1] - w + 1
            total = None
            for k, part in enumerate(parts):
                index = (pair if len(part) == 65536 else rows)[:, 2 * k : 2 * k + n]
                got = np.take(part, index, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            best.append(total.max(axis=1))
        z = np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, filled up with zeros; their text and their number of bytes."""
    count = -(-(off[1:] - off[:-1]) // WINDOW)
    owner = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = off[owner] + nth * WINDOW
    size = np.minimum(off[owner + 1] - start, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy()
    rows[np.arange(WINDOW)[None] >= size[:, None]] = 0
    return rows, owner, size


def train(rows: np.ndarray, target: np.ndarray, classes: list[str], *, embed: int = 8, filters: int = 16, epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 5) -> ByteCnn:
    """Adam on the cross-entropy of single windows; gradients pass only through each filter's maximum."""
    rng = np.random.default_rng(seed)
    total = filters * len(WIDTHS)
    p = [rng.normal(0, 0.3, (256, embed))]
    p += [rng.normal(0, (w * embed) ** -0.5, (w * embed, filters)) for w in WIDTHS]
    p += [np.zeros(total), rng.normal(0, total**-0.5, (total, len(classes))), np.zeros(len(classes))]
    p = [x.astype(np.float32) for x in p]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            x, y = rows[order[at : at + batch]], target[order[at : at + batch]]
            n, emb = len(x), p[0][x]
            flat = emb.reshape(n, -1)
            peaks, tops = [], []
            for k, w in enumerate(WIDTHS):
                slid = np.lib.stride_tricks.sliding_window_view(flat, w * embed, axis=1)[:, ::embed]
                conv = slid @ p[1 + k]
                where = conv.argmax(axis=1)
                peaks.append(where)
                tops.append(np.take_along_axis(conv, where[:, None], 1)[:, 0])
            pre = np.concatenate(tops, axis=1) + p[-3]
            act = np.maximum(pre, 0)
            z = act @ p[-2] + p[-1]
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(n), y] -= 1
            dz = prob / n
            da = (dz @ p[-2].T) * (pre > 0)
            grads = [np.zeros_like(p[0])]
            for k, w in enumerate(WIDTHS):
                g = da[:, k * filters : (k + 1) * filters]
                spot = x[np.arange(n)[:, None, None], peaks[k][:, :, None] + np.arange(w)]  # n, filters, w
                seen = p[0][spot].reshape(n, filters, w * embed)
                grads.append(np.einsum("nf,nfe->ef", g, seen))
                back = g[:, :, None] * p[1 + k].T[None]
                np.add.at(grads[0], spot.ravel(), back.reshape(-1, embed))
            grads += [da.sum(0), act.T @ dz, dz.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
    return ByteCnn(classes, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1])


def sample_windows(labelled: DataFrame, text: str, lang: str, key: Column, per_class: int, per_text: int) -> list:
    """Windows (hex bytes and label) spread over a bounded sample of texts; per_text of each at most."""

    def take(batches):
        for b in batches:
            rows, owner, _ = cut_windows(*tb.flat(pc.utf8_lower(b.column(0))))
            count = np.bincount(owner, minlength=b.num_rows)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            stride = np.maximum(count[owner] // per_text, 1)
            keep = np.flatnonzero((nth % stride == 0) & (nth // stride < per_text))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows[keep]], pa.binary()), b.column(1).take(pa.array(owner[keep]))], ["window", "lang"])

    picked = bounded_sample(labelled, lang, F.xxhash64(key, F.col(text)), per_class).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return picked.mapInArrow(take, "window binary, lang string").collect()


def junk(rows: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """Windows in no language: bytes of given windows in random order, and random letters, half of each.

    Windows of fewer than 32 bytes are not used: a few bytes in another order may well be a word.
    """
    rng = np.random.default_rng(seed)
    full = rows[(rows != 0).sum(axis=1) >= 32]
    out = full[rng.integers(0, len(full), count)] if len(full) else np.zeros((0, WINDOW), np.uint8)
    size = (out != 0).sum(axis=1)
    place = np.where(np.arange(WINDOW)[None] < size[:, None], rng.random(out.shape), 2)
    out = np.take_along_axis(out, place.argsort(axis=1), axis=1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    half = len(out) // 2
    out[:half] = np.where(out[:half] != 0, letters[rng.integers(0, len(letters), out[:half].shape)], 0)
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_class: int = 400, per_text: int = 6, reject: bool = False) -> ByteCnn | None:
    """Train on about per_class texts of each language, per_text windows of each: a bounded sample, gathered on the driver.

    With reject, `und` is a class of its own, learned from as many windows of junk() as a language has, so a text of letters in no
    language is rejected however few languages there are.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    got = sorted(sample_windows(usable, text, lang, F.col(key), per_class, per_text), key=lambda r: (bytes(r[0]), r[1]))
    classes = sorted({r[1] for r in got})
    if not classes:
        return None
    rows = np.frombuffer(b"".join(bytes(r[0]) for r in got), np.uint8).reshape(-1, WINDOW)
    target = np.array([classes.index(r[1]) for r in got])
    if reject:
        none = junk(rows, len(rows) // len(classes))
        classes = classes if UNKNOWN in classes else [*classes, UNKNOWN]
        rows, target = np.concatenate([rows, none]), np.concatenate([target, np.full(len(none), classes.index(UNKNOWN))])
    return train(rows, target, classes)


def predictor(spark, model: ByteCnn | None):
    """Column function: text -> struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)
    kind = "lang string, score double"
    ready: list = []

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        m = shared.value
        if not ready:
            ready.append(m.tables())
        data, off = tb.flat(pc.utf8_lower(texts))
        sums = np.zeros((len(texts), len(m.classes)))
        for a, b in tb.chunks(off, 1 << 17):
            rows, owner, size = cut_windows(data[off[a] : off[b]], off[a : b + 1] - off[a])
            for at in range(0, len(rows), 256):
                prob = m.window_probabilities(rows[at : at + 256], ready[0])
                np.add.at(sums, owner[at : at + 256] + a, prob * size[at : at + 256, None])
        mean = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-30)
        best = mean.argmax(axis=1)
        score = np.minimum(mean[np.arange(len(best)), best], 1.0)
        return pa.StructArray.from_arrays([pa.array(np.array(m.classes, object)[best], pa.string()), pa.array(score)], ["lang", "score"])

    def column(text: Column) -> Column:
        unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        if model is None:
            return unknown
        readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        return F.when(readable, apply(text)).otherwise(unknown)

    return column


def rejected(text: Column, guess: Column) -> Column:
    """Whether a text is in no known language, by a predictor whose model has `und` as a class: it has no letter, or `und` is likeliest.

    A text of less than one window is rejected for want of letters only: one number or name in it may outweigh its words.
    """
    return ~F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) | ((guess["lang"] == UNKNOWN) & (F.octet_length(text) >= WINDOW))


def op1_language(spark, docs: DataFrame) -> DataFrame:
    """Contract columns of op1 for every row of docs. A row without id is held out."""
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(True))
    model = fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), predictor(spark, model)(F.col("text")).alias("_p")).select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
