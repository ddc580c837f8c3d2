"""Fingerprints, keyed hashes, hash chains, Merkle trees with proofs, checks of rows against what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def keyed_hash(key: bytes, message: Column) -> Column:
    """HMAC with SHA-256, as lower-case hex. The key stays in the plan: don't log plans of production keys."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\x00")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def chain_breaks(rows: DataFrame, chain: str, seq: str, previous: str, digest: str, content: Column) -> DataFrame:
    """Rows whose own hash, link to the row before, or number is wrong, with the reason. One window per chain."""
    w = Window.partitionBy(chain).orderBy(seq)
    r = rows.withColumn("_p", F.lag(digest).over(w)).withColumn("_s", F.lag(seq).over(w))
    why = F.when(F.col(digest) != F.sha2(F.concat(F.col(previous), content), 256), "content").when(F.col("_s").isNotNull() & (F.col(seq) != F.col("_s") + 1), "sequence").when(F.col(previous) != F.coalesce("_p", F.lit("")), "link")
    return r.withColumn("reason", why).where("reason IS NOT NULL").drop("_p", "_s")


def log_problems(heads: DataFrame, entries: DataFrame, content: Column) -> DataFrame:
    """log, seq, problem: everything wrong with operation logs.

    heads: log, header (hash that the first entry points at), head (the last hash that was recorded, or null), count (or null).
    entries: log, seq, uid, prev, digest, supersedes, and the columns of content.
    """
    w = Window.partitionBy("log").orderBy("seq")
    e = entries.join(heads.select("log", "header"), "log").withColumns({"_before": F.coalesce(F.lag("digest").over(w), F.col("header")), "_n": F.row_number().over(w)})
    first = entries.groupBy("log", F.col("uid").alias("supersedes")).agg(F.min("seq").alias("_at"))
    e = e.join(first, ["log", "supersedes"], "left")
    said = F.array_compact(F.array(
        F.when(F.col("seq") != F.col("_n"), "sequence_gap"), F.when(~F.col("prev").eqNullSafe(F.col("_before")), "prev_hash_mismatch"), F.when(F.col("digest") != F.sha2(F.concat("prev", content), 256), "content_changed"),
        F.when(F.col("supersedes").isNotNull() & (F.coalesce("_at", F.lit(2**62)) >= F.col("seq")), "bad_amendment_link"),
    ))
    rows = e.select("log", "seq", F.explode(said).alias("problem"))
    last = entries.groupBy("log").agg(F.max_by("digest", "seq").alias("last"), F.count("*").alias("n"))
    h = heads.join(last, "log", "left")
    whole = F.array_compact(F.array(F.when(F.col("head").isNotNull() & (F.col("head") != F.coalesce("last", "header")), "head_mismatch"), F.when(F.col("count").isNotNull() & (F.col("count") != F.coalesce("n", F.lit(0))), "count_mismatch")))
    return rows.unionByName(h.select("log", F.coalesce("n", F.lit(0)).cast("long").alias("seq"), F.explode(whole).alias("problem")).select("log", F.col("seq").cast(entries.schema["seq"].dataType).alias("seq"), "problem"))


def _leaf(digest: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\x00"), F.unhex(digest)), 256))


def _node(a: Column, b: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\x01"), a, b), 256))


def merkle_tree(leaves: DataFrame, group: str, position: str, digest: str) -> DataFrame:
    """group, level, position, hash (binary) of every node. Leaves are marked by a byte 0, nodes by a byte 1; an odd last one moves up as it is.

    Each level is a grouping by half the position, so large trees spread over the cluster; there are as many levels as the
    logarithm of the largest group.
    """
    level = leaves.select(group, F.lit(0).alias("level"), F.col(position).cast("long").alias("position"), _leaf(F.col(digest)).alias("hash"))
    most = leaves.agg(F.max(position)).first()[0] or 0
    tree, depth = level, 0
    while most:
        depth += 1
        pair = level.groupBy(group, F.floor(F.col("position") / 2).alias("position")).agg(F.min_by("hash", "position").alias("a"), F.max_by("hash", "position").alias("b"), F.count("*").alias("n"))
        level = pair.select(group, F.lit(depth).alias("level"), "position", F.when(F.col("n") == 2, _node(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("hash"))
        tree = tree.unionByName(level)
        most //= 2
    return tree


def merkle_roots(leaves: DataFrame, group: str, position: str, digest: str) -> DataFrame:
    """group, root (hex)."""
    tree = merkle_tree(leaves, group, position, digest)
    top = tree.groupBy(group).agg(F.max("level").alias("level"))
    return tree.where("position = 0").join(top, [group, "level"]).select(group, F.lower(F.hex("hash")).alias("root"))


def merkle_proofs(leaves: DataFrame, group: str, position: str, digest: str) -> DataFrame:
    """group, position, digest, path: side (L or R) and hash (hex) of the siblings up to the root."""
    tree = merkle_tree(leaves, group, position, digest)
    start = leaves.select(group, F.col(position).cast("long").alias("position"), F.col(digest).alias("digest"))
    depth = tree.agg(F.max("level")).first()[0] or 0
    steps = start.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0))))).withColumn("at", F.expr("shiftright(position, level)"))
    sibling = F.when(F.col("at") % 2 == 0, F.col("at") + 1).otherwise(F.col("at") - 1)
    met = steps.withColumn("sibling", sibling).join(tree.select(group, "level", F.col("position").alias("sibling"), "hash"), [group, "level", "sibling"])
    hop = F.struct("level", F.when(F.col("at") % 2 == 0, "R").otherwise("L").alias("side"), F.lower(F.hex("hash")).alias("hash"))
    paths = met.groupBy(group, "position").agg(F.array_sort(F.collect_list(hop)).alias("path"))
    return start.join(paths, [group, "position"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<level:int,side:string,hash:string>>")))


def merkle_verified(digest: Column, path: Column, root: Column) -> Column:
    """Whether the path leads from the digest to the root."""
    up = F.aggregate(path, _leaf(digest), lambda acc, p: F.when(p["side"] == "L", _node(F.unhex(p["hash"]), acc)).otherwise(_node(acc, F.unhex(p["hash"]))))
    return F.lower(F.hex(up)) == F.lower(root)


def row_check(live: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: rows that nothing recorded, that changed, or that are gone. live, recorded: keys, digest."""
    j = live.select(*keys, F.col("digest").alias("_l")).join(recorded.select(*keys, F.col("digest").alias("_r")), keys, "full")
    why = F.when(F.col("_r").isNull(), "unrecorded").when(F.col("_l").isNull(), "missing").when(F.col("_l") != F.col("_r"), "modified")
    return j.select(*keys, why.alias("problem")).where("problem IS NOT NULL")


def sanitised(value: Column, name: Column) -> Column:
    """Identifier-like values of fields whose name says so stay; others are replaced by the start of their hash."""
    safe = name.rlike("(?i)(^|_)(id|uid|code|number|sha256|hash|status|kind|type)$") & value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,79}$")
    return F.when(safe, value).when(F.coalesce(value, F.lit("")) != "", F.left(F.sha2(value, 256), F.lit(32)))


def verdict(problems: Column, unchecked: Column) -> Column:
    return F.when(problems > 0, "TAMPERING DETECTED").when(unchecked > 0, "PARTIAL").otherwise("INTACT")
