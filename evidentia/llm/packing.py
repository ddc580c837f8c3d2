"""Best-fit packing of documents into fixed-size training sequences, with conflicts.

Lengths are UTF-8 bytes. A text longer than a bin gives full bins of its own and a last piece; last pieces and shorter texts
are packed by best fit in decreasing order of length: bins stand ordered by what is free in them, and from the first that
is large enough the search goes on to the next larger one until a bin has neither the piece's source nor its duplicate
cluster. Sources and clusters of a bin are bitmaps; a new bin opens only if no bin is compatible.

Pieces are dealt by a hash to groups of about GROUP rows, each packed by one task, so a hot source or cluster spreads over
all groups, memory is bounded, and a lost task repeats with the same result. Bin numbers are unique over all groups.

Null and empty texts have length 0 and one piece, which needs a bin too. A null source conflicts with nothing. Equal texts
form a cluster unless another cluster column is given; a null cluster conflicts with nothing. Repeated rows are rows.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
GROUP = 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece, in the given order of pieces."""
    free: list[tuple[int, int]] = []  # (free, bin), ordered
    source_bit, cluster_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources)) if s is not None}, {}
    seen: set = set()
    for c in clusters:
        if c is not None and c in seen:
            cluster_bit.setdefault(c, 1 << len(cluster_bit))
        seen.add(c)
    holds: list[tuple[int, int]] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        at = bisect.bisect_left(free, (n, -1))
        while at < len(free) and (holds[free[at][1]][0] & sb or holds[free[at][1]][1] & cb):
            at += 1
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(holds)
            holds.append((0, 0))
        holds[b] = (holds[b][0] | sb, holds[b][1] | cb)
        bisect.insort(free, (room - n, b))
        out.append(b)
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, bin, bin_offset: one row for each piece of each row of docs. start and length are in bytes."""
    kind = docs.schema[key].dataType.simpleString()
    same = F.when(F.octet_length(text) > 0, F.xxhash64(text)) if cluster is None else F.xxhash64(cluster)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), same.cast("string").alias("cluster"), F.xxhash64(text).alias("hash"))
    groups = max(1, -(-docs.count() // GROUP))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(full=pdf["size"] // capacity, part=pdf["size"] % capacity)
        pdf.loc[(pdf.part == 0) & (pdf.full > 0), ["full", "part"]] += [-1, capacity]
        pdf = pdf.sort_values(["part", "key", "hash", "size"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        plain = lambda c: [None if pd.isna(x) else x for x in c]
        bins = best_fit(pdf.part.tolist(), plain(pdf.source), plain(pdf.cluster), capacity)
        used: dict[int, int] = {}
        offset = []
        for b, n in zip(bins, pdf.part.tolist(), strict=True):
            offset.append(used.get(b, 0))
            used[b] = offset[-1] + n
        first_full = (len(used) + pdf.full.cumsum() - pdf.full).to_numpy()
        last = pd.DataFrame({"key": pdf.key, "piece": pdf.full, "start": pdf.full * capacity, "length": pdf.part, "bin": bins, "bin_offset": offset})
        many = pdf.loc[pdf.index.repeat(pdf.full)]
        nth = many.groupby(level=0).cumcount().to_numpy()
        whole = pd.DataFrame({"key": many.key.to_numpy(), "piece": nth, "start": nth * capacity, "length": capacity, "bin": first_full[many.index.to_numpy()] + nth, "bin_offset": 0})
        out = pd.concat([last, whole], ignore_index=True)
        out["grp"] = pdf.grp.iloc[0]
        return out

    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key", "hash"), F.lit(groups)))
    packed = rows.groupBy("grp").applyInPandas(local, "key string, piece long, start long, length long, bin long, bin_offset long, grp long")
    return packed.select(F.col("key").cast(kind).alias(key), "piece", "start", "length", (F.col("grp") * F.lit(1 << 32) + F.col("bin")).alias("bin"), "bin_offset")


def op2_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
