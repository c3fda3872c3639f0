"""Sharding by a k-d tree over document metadata.

Every document is a point of metadata, by default the size of its text, its source and its
language, each mapped to 0..2^32-1: numbers in proportion (sizes by their logarithm), text by the first
bytes that tell its values apart, in their order. Below them lie
31 bits of a hash of the whole row, so that equal values still have an order.
A node is split at the weighted median, by bytes, of the dimension that is widest
within it (in shares of the whole table's extent), and the halves again until no leaf has more than the target bytes (a
power of two of leaves; the query asks for 16 instead). No row moves for that: weighted medians are found by
radix refinement, where each round sums bytes by (node, next 12 bits) for the
values that share the median's bits so far; at most nodes x 4096 sums a
round reach the driver. Values tied with the cut after all 63 bits (repeated
rows) stay on its left side.

Slots are gapless within a shard; they are counted by (shard, salt) groups, never
by a sort of a whole shard. Defined results: null text has size 1 and
CRC 0; null metadata is the value 0 of its dimension; an empty table
gives no rows; columns of the same names as the result's are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import saved
from ringloom.llm.packing import ranked

BITS, TIE = 12, 31
#: A bin of at most this share of the half node is not refined further.
EVEN = 1e-5
DIMS = ("size", "source", "lang")
TOP = (1 << 32) - 1


def _place(docs: DataFrame, dims: tuple[str, ...]) -> list[Column]:
    """Each dimension as 0..TOP: its share of the extent that it has in docs; null is 0."""
    kinds = dict(docs.dtypes)
    number = lambda c: F.log2("_size") if c == "size" and c not in kinds else F.col(c).cast("double")
    # text in the order of its bytes: the first 8 behind those that all values share
    numeric = {c: c == "size" and c not in kinds or kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for c in dims}
    span = docs.agg(*(f(number(c) if numeric[c] else F.col(c).cast("string")).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max))).first()
    out = []
    for c in dims:
        lo, hi = span[f"min_{c}"], span[f"max_{c}"]
        if lo is None:
            out.append(F.lit(0).cast("long"))
            continue
        value = number(c)
        if not numeric[c]:
            lo, hi = (x.encode() for x in (lo, hi))
            skip = next((i for i, (x, y) in enumerate(zip(lo, hi, strict=False)) if x != y), min(len(lo), len(hi)))
            code = lambda x: int.from_bytes(x[skip : skip + 6].ljust(6, b"\0"), "big")  # noqa: B023, E731
            lo, hi = float(code(lo)), float(code(hi))
            tail = F.rpad(F.hex(F.substring(F.col(c).cast("string").cast("binary"), skip + 1, 6)), 12, "0")
            value = F.conv(tail, 16, 10).cast("double")
        share = (value - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) if hi > lo else F.lit(0.0)
        out.append(F.coalesce((F.least(F.greatest(F.nanvl(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (TOP - 1)).cast("long") + 1, F.lit(0).cast("long")))
    return out


def points(docs: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """doc_id, size, text_crc32 and keys: one 63-bit order key per dimension."""
    docs = docs.select("doc_id", "text", *(c for c in dims if c in docs.columns and c not in ("doc_id", "text")), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("_size"))
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - TIE)
    keys = F.array(*(F.shiftleft(v, TIE).bitwiseOR(tie) for v in _place(docs, dims)))
    return docs.select("doc_id", F.col("_size").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), keys.alias("keys"))


#: A node's box: (dimension, cut, whether keys lie above the cut) of each split on its path.
Box = tuple[tuple[int, int, bool], ...]


def _in(box: Box) -> Column:
    out = F.lit(True)
    for dim, cut, above in box:
        out = out & ((F.get("keys", dim) > cut) if above else (F.get("keys", dim) <= cut))
    return out


def _per_node(boxes: dict[int, Box], value: dict[int, Column]) -> Column:
    """The value of the node a row lies in; null outside all of them."""
    out = F.when(F.lit(False), next(iter(value.values())))
    for n, v in value.items():
        out = out.when(_in(boxes[n]), v)
    return out


def _cuts(pts: DataFrame, boxes: dict[int, Box], n_dims: int) -> dict[int, tuple[int, int]]:
    """For each node that has rows its widest dimension and the 63-bit cut: keys <= cut go left."""
    node = _per_node(boxes, {n: F.lit(n) for n in boxes}).alias("node")
    lows = (F.min(F.get("keys", i)).alias(f"lo{i}") for i in range(n_dims))
    highs = (F.max(F.get("keys", i)).alias(f"hi{i}") for i in range(n_dims))
    ext = {r["node"]: r for r in pts.groupBy(node).agg(F.sum("size").alias("bytes"), *lows, *highs).collect()}
    if not ext:
        return {}
    # the tie bits are no extent
    dim = {n: max(range(n_dims), key=lambda i: ((r[f"hi{i}"] >> TIE) - (r[f"lo{i}"] >> TIE), -i)) for n, r in ext.items()}
    goal = {n: r["bytes"] / 2 for n, r in ext.items()}
    prefix, below, cut, left = dict.fromkeys(ext, 0), dict.fromkeys(ext, 0), {}, 63
    while len(cut) < len(ext):
        todo, step = [n for n in ext if n not in cut], min(BITS, left)
        high, left = left, left - step
        keyed = pts.select(node, _per_node(boxes, {n: F.when(F.shiftright(F.get("keys", dim[n]), high) == prefix[n], F.shiftright(F.get("keys", dim[n]), left)) for n in todo}).alias("bin"), "size")
        sums: dict[int, list] = {n: [] for n in todo}
        for r in keyed.where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect():
            sums[r["node"]].append((r["bin"], r["bytes"]))
        for n in todo:
            for prefix[n], w in sorted(sums[n]):
                if below[n] + w >= goal[n]:
                    break
                below[n] += w
            if not left or w <= goal[n] * EVEN:
                # the bin in question goes to the side that it leaves nearer to the median
                take = abs(below[n] + w - goal[n]) <= abs(below[n] - goal[n])
                cut[n] = ((prefix[n] + take) << left) - 1
    return {n: (dim[n], c) for n, c in cut.items()}


def kd_shards(docs: DataFrame, levels: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of near equal bytes, 2**levels of them, or as
    many as keep each at target_bytes or less on average (256 MB if neither is given). dims: columns of docs, numbers or text;
    size is the text's own if docs has no such column."""
    pts = saved(points(docs.drop("size") if dims == DIMS else docs, dims), "points")
    rows, total = pts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if levels is None:
        levels = max(0, math.ceil(math.log2(max(1.0, total / (target_bytes or 1 << 28)))))
    boxes: dict[int, Box] = {0: ()}
    for _ in range(levels):
        cuts = _cuts(pts, boxes, len(dims))
        if not cuts:
            break
        boxes = {2 * n + up: (*boxes[n], (d, c, up)) for n, (d, c) in cuts.items() for up in (False, True)}
    shard = _per_node(boxes, {n: F.lit(n) for n in boxes}) if boxes else F.lit(0)
    df = pts.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"))
    out = ranked(df, "shard", ["doc_id", "text_crc32", "size"], "slot", rows)
    return out.withColumn("grown_shard", F.lit(None).cast("int"))
