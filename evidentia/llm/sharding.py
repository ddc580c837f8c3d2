"""Shards of nearly equal bytes by a minimax contiguous partition: DataFrame functions only.

Equal texts are atomic groups, ordered by the hash of their text. The smallest shard capacity for which a greedy pass fits
all groups into the shards is found by binary search; the cuts are made there. The driver never sees single groups of the
whole corpus: it searches over sums of hash ranges, FIRST of them at first, and only ranges in which a cut can still fall
are split further (SPLIT ways a round), until the bounds for the capacity meet.

A null text counts as empty. Repeated rows are rows like any other. An empty table gives no rows. One group can be larger
than an equal share; it then is a shard with what else fits, as no contiguous partition of whole groups can do better.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FIRST, SPLIT = 12, 8  # bits
SLOT_ROWS = 50_000


@dataclass(order=True)
class Cell:
    """Groups whose keys agree but for the last shift bits: the first key, their bytes, the largest group, how many."""

    key: int
    total: int
    largest: int
    groups: int
    shift: int


def _shards_needed(cells: list[Cell], capacity: int, fluid: bool, limit: int) -> tuple[int, list[int]]:
    """Greedy pass. fluid: cells of several groups can be cut anywhere, else nowhere. Also the index of the cell at each cut."""
    used, free, cuts = 1, capacity, []
    for i, c in enumerate(cells):
        if fluid and c.groups > 1:
            rest = c.total
            while rest > free and used <= limit:
                rest, free, used = rest - free, capacity, used + 1
                cuts.append(i)
            free -= rest
        else:
            if c.total > free:
                used, free = used + 1, capacity
                cuts.append(i)
            free -= c.total
            if free < 0:
                return limit + 1, cuts
        if used > limit:
            break
    return used, cuts


def _least(cells: list[Cell], shards: int, fluid: bool) -> int:
    total, largest = sum(c.total for c in cells), max(c.largest if fluid else c.total for c in cells)
    low, high = max(largest, -(-total // shards)), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if _shards_needed(cells, mid, fluid, shards)[0] <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _unsure(cells: list[Cell], low: int, high: int, shards: int) -> list[int]:
    """Cells of several groups in which a cut can fall for a capacity between the bounds."""
    early, late = _shards_needed(cells, max(low, max(c.total for c in cells)), False, shards)[1], _shards_needed(cells, high, True, shards)[1]
    big = [i for i, c in enumerate(cells) if c.groups > 1 and c.total * shards * 64 > sum(x.total for x in cells)]
    if big:
        return big
    out, last = set(), len(cells) - 1
    for j in range(shards - 1):
        a, b = early[j] if j < len(early) else last, late[j] if j < len(late) else last
        out.update(range(min(a, b), max(a, b) + 1))
    return sorted(i for i in out if cells[i].groups > 1)


def _balanced(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """Keys that begin shards 1, 2, ...: within the capacity, each cut as near to an equal share of the rest as it can be."""
    starts, i, rest = [], 0, sum(c.total for c in cells)
    for left in range(shards, 1, -1):
        best, filled, j = i, 0, i
        while j < len(cells) and filled + cells[j].total <= capacity:
            nearer = abs((filled + cells[j].total) * left - rest) <= abs(filled * left - rest)
            filled += cells[j].total
            j += 1
            tail = cells[j:]
            if nearer or not tail or _shards_needed(cells[best:], capacity, False, left - 1)[0] > left - 1:
                best = j
            else:
                break
        rest -= sum(c.total for c in cells[i:best])
        i = best
        if i >= len(cells):
            break
        starts.append(cells[i].key)
    return starts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1, 2, ... and the capacity. groups: key (long, distinct), bytes."""

    def sums(rows: DataFrame, shift: int) -> list[Cell]:
        got = rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.min("key"), F.sum("bytes"), F.max("bytes"), F.count("*"))
        return [Cell(*map(int, r[1:]), shift) for r in got.collect()]  # FIRST and SPLIT bound the number of cells

    cells = sorted(sums(groups, 64 - FIRST))
    if not cells:
        return [], 0
    while True:
        low, high = _least(cells, shards, True), _least(cells, shards, False)
        split = _unsure(cells, low, high, shards) if low < high else []
        if not split:
            return _balanced(cells, high, shards), high
        gone = set(split)
        left = [c for i, c in enumerate(cells) if i not in gone]
        for shift in sorted({cells[i].shift for i in split}):
            ids = groups.sparkSession.createDataFrame([(cells[i].key >> shift,) for i in split if cells[i].shift == shift], "cell long")
            left += sums(groups.join(F.broadcast(ids), F.shiftright("key", shift) == F.col("cell"), "left_semi"), max(shift - SPLIT, 0))
        cells = sorted(left)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def assign(docs: DataFrame, text: str = "text", shards: int = 16) -> tuple[DataFrame, int]:
    """docs with _bytes and _shard; the number of rows."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    groups = cut(docs.select(_text_key(F.col(text)).alias("key"), size.alias("bytes")).groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")))
    starts, _ = minimax_cuts(groups, shards)
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    shard = F.lit(0)
    for s in starts:
        shard = shard + (_text_key(F.col(text)) >= F.lit(s).cast("long")).cast("int")
    return docs.withColumn("_bytes", size).withColumn("_shard", shard), rows


def op5_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract columns of op5 for every row of docs. Slots are counted by hash buckets, so no task ranks a whole shard."""
    rows, count = assign(docs.select("doc_id", "text"), "text", shards)
    buckets = max(64, -(-count // shards // SLOT_ROWS))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.select("doc_id", F.col("_bytes").alias("size"), crc.alias("text_crc32"), F.col("_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", crc), F.lit(buckets)).alias("bucket"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.withColumn("place", place).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
