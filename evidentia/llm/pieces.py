"""SentencePiece encoding and decoding by a forward pass that words share along common prefixes.

Each batch's texts are normalised and cut into marked words. The distinct words that the worker has not met yet are sorted,
which makes them a trie in depth-first order: from one word to the next, the forward states of the common prefix stay and
only the rest is computed. A state is the last piece of the best segmentation of the prefix. An automaton over the pieces tells
which of them end at a character.

The given model segments by merges. There the best path is the only one whose neighbours are compatible: two pieces are, if
merging their joined text gives just these two. So a state needs one look at each piece that ends there, as in a Viterbi
pass whose transitions cost nothing or are barred, and the result equals the model's own. Words of several marks in a row,
whose pieces tie in score, are merged directly.

Null texts have null ids; empty texts have none. Characters outside the vocabulary become byte pieces. Decoding returns the
text unless normalisation changed it. A word's cost is linear in its length, that of a run of marks n log n; the cache of
words is bounded (CACHE) and outlasts a task. Ties in score go to the leftmost pair. Repeated rows each get their ids; an empty table gives no
rows; very long texts are whole words like others; other columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CACHE = 500_000
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.vocab_size()
        text = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)) for i in range(n)]
        self.id = {text[i]: i for i in range(n) if plain[i]}
        self.score = {i: self.sp.get_score(i) for i in self.id.values()}
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.raw = [of_byte.get(i, b"" if self.sp.is_control(i) else text[i].replace(MARK, " ").encode()) for i in range(n)]
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.id)
        #: Pieces in the order in which they are merged, single characters first.
        self.piece = sorted(self.id, key=lambda p: (len(p) > 1, -self.score[self.id[p]], self.id[p]))
        self.rank = {p: r for r, p in enumerate(self.piece)}
        self.code = [self.id[p] for p in self.piece]
        self.root = self.automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}  # by the first piece times their number, and the second
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words of the cache's last filling
        #: Whether all pieces, bytes included, read as what they stand for.
        self.faithful = all(self.raw[k] == p.replace(MARK, " ").encode() for p, k in self.id.items()) and all(self.raw[k] == bytes([b]) for b, k in enumerate(self.byte))

    def automaton(self) -> list:
        """Nodes: children by character, the node of the longest proper suffix, rank and length of the pieces that end here, longest first."""
        root: list = [{}, None, ()]
        for r, p in enumerate(self.piece):
            node = root
            for c in p:
                node = node[0].setdefault(c, [{}, root, ()])
            node[2] = ((r, len(p)),)
        level = list(root[0].values())
        while level:
            for node in level:
                node[2] += node[1][2]
                for c, child in node[0].items():
                    back = node[1]
                    while back is not root and c not in back[0]:
                        back = back[1]
                    child[1] = back[0].get(c, root)
            level = [child for node in level for child in node[0].values()]
        return root

    def merged(self, word: str) -> tuple[list[str], tuple[str, str]]:
        """Pieces by merging: best score first, then leftmost. Also the two sides of the last merge. A heap holds the pairs."""
        parts, sides = list(word), ("", "")
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                k = self.id.get(parts[i] + parts[after[i]])
                if k is not None:
                    heappush(heap, (-self.score[k], i, parts[i] + parts[after[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, text = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != text:
                continue  # one of the two has been merged since
            sides = (parts[i], parts[j])
            parts[i], parts[j], after[i] = text, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None], sides

    def sides(self, r: int) -> tuple[int, int] | None:
        """The two pieces that merge to r, r twice for a character; none if its text doesn't merge to it."""
        if r not in self.halves:
            p = self.piece[r]
            parts, (a, b) = self.merged(p)
            self.halves[r] = (r, r) if len(p) == 1 else (self.rank[a], self.rank[b]) if parts == [p] else None
        return self.halves[r]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: nothing across their border merges before they are complete.

        Undoing the later of the two merges, again and again, gives the pieces that stood at the border at each time.
        """
        fit = self.fits.get(a * len(self.piece) + b)
        if fit is not None:
            return fit
        x, y, before = a, b, len(self.piece)
        fit = True
        while True:
            joined = self.rank.get(self.piece[x] + self.piece[y])
            if joined is not None and joined < before:
                fit = False
                break
            undo_left = x > y
            sides = self.sides(x if undo_left else y)
            if sides[0] == (x if undo_left else y):  # a character: only the other can be undone
                undo_left = not undo_left
                sides = self.sides(x if undo_left else y)
                if sides[0] == (x if undo_left else y):
                    break
            before = x if undo_left else y + 1
            x, y = (sides[1], y) if undo_left else (x, sides[0])
        if len(self.fits) > CACHE:
            self.fits.clear()
        self.fits[a * len(self.piece) + b] = fit
        return fit

    def ids_of(self, parts: list[str]) -> bytes:
        out = []
        for p in parts:
            k = self.id.get(p)
            out += [k] if k is not None else [self.byte[b] for b in p.encode()]
        return np.array(out, np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Segment the words, in sorted order, and keep the results."""
        fits, compatible, code, sides, root, cache = self.fits, self.compatible, self.code, self.sides, self.root, self.cache
        size = len(self.piece)
        # states[i]: rank of the last piece of the first i characters; -1: none or unknown. nodes[i]: of the automaton, after them.
        last, states, starts, nodes = "", [-1], [0], [root]
        for word in sorted(words):
            if word.startswith(MARK * 2):
                cache[word] = self.ids_of(self.merged(word)[0])
                continue
            same = 0
            for x, y in zip(last, word):  # noqa: B905
                if x != y:
                    break
                same += 1
            del states[same + 1 :], starts[same + 1 :], nodes[same + 1 :]
            node, end = nodes[same], same
            for c in word[same:]:
                end += 1
                to = node[0].get(c)
                while to is None:
                    node = node[1]
                    to = root if node is None else node[0].get(c)
                node = to
                nodes.append(node)
                for r, long in node[2]:
                    before = states[end - long]
                    if before < 0:
                        fit = sides(r) is not None
                    else:
                        fit = fits.get(before * size + r)
                        if fit is None:
                            fit = sides(r) is not None and compatible(before, r)
                    if fit:
                        states.append(r)
                        starts.append(end - long)
                        break
                else:
                    states.append(-1)
                    starts.append(end - 1)
            last, out, end = word, [], len(word)
            while end:
                r = states[end]
                if r < 0:
                    out += [self.byte[b] for b in reversed(word[starts[end] : end].encode())]
                else:
                    out.append(code[r])
                end = starts[end]
            out.reverse()
            cache[word] = array("i", out).tobytes()

    def meet(self, words: set[str]) -> None:
        """Have all these words in the cache. A full one becomes the older one, from which words that come again are taken back."""
        fresh = words - self.cache.keys()
        if len(self.cache) + len(fresh) > CACHE // 2:
            self.older, self.cache, fresh = self.cache, {}, words
        again = fresh & self.older.keys()
        self.cache.update((w, self.older[w]) for w in again)
        self.learn(fresh - again)

    def read(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """32-bit ids of each text, none for null, and whether decoding them gives the text again (true for null).

        Pieces and bytes stand one after the other for all of the normal form. If each reads as what it stands for, decoding gives
        that form with spaces for marks, so it need not be done.
        """
        normal = ["" if t is None else self.sp.normalize(t) for t in texts]
        words = [_WORD.findall(t) if self.words_apart or not t else [t] for t in normal]
        self.meet(set().union(*words))
        get = self.cache.__getitem__
        ids = [b"".join(map(get, row)) for row in words]
        back = [n.replace(MARK, " ").removeprefix(" ") for n in normal] if self.faithful else [self.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
        return ids, [t is None or t == b for t, b in zip(texts, back, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.read(texts)[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


#: The model that this worker has used last, by digest, with the words it has met: the next task goes on with it.
_READY: dict[str, Pieces] = {}


def _ready(digest: str, model) -> Pieces:
    if digest not in _READY:
        _READY.clear()
        _READY[digest] = Pieces(model.value)
    return _READY[digest]


def _reader(spark, model: str):
    data = Path(model).read_bytes()
    shared, digest = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()  # a model file, of fixed size
    return lambda: _ready(digest, shared)


def encoder(spark, model: str = MODEL):
    """Column function: text -> struct(ids, round_trip): the ids, and whether decoding them gives the text again."""
    pieces = _reader(spark, model)

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def encode(texts: pa.Array) -> pa.Array:
        p, ids, same = pieces(), [], []
        for at in range(0, len(texts), 1024):
            got, back = p.read(texts.slice(at, 1024).to_pylist())
            ids += got
            same += back
        off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(off), flat, mask=texts.is_null() if texts.null_count else None)
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return encode


def decoder(spark, model: str = MODEL):
    """Column function: ids -> text."""
    pieces = _reader(spark, model)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        p = pieces()
        return pa.array([None if x is None else p.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def op8_pieces(spark, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (decoding gives the text again) for every row of docs."""
    coded = docs.select("doc_id", encoder(spark, model)(F.col("text")).alias("_p"))
    return coded.select("doc_id", F.coalesce(F.size("_p.ids"), F.lit(0)).cast("long").alias("n_tokens"), "_p.ids", "_p.round_trip")
