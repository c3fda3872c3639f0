"""Near-duplicate vectors through a pivot-permutation index.

1. Equal vectors are one class (its smallest vec_id and size); vectors that are
   null, zero or hold null or non-finite components link with nothing.
2. Reference points are chosen farthest-first from a bounded sample of the classes
   (at most about ``SAMPLE`` of a dimension) until there are 2 * sqrt(n) of them (128 to 2,048) or
   each vector of the sample has a pivot of cosine ``APART`` or more; so a group of near vectors, however
   large, holds a few pivots at most and the others tell its members' order apart. A
   vector is described by its ``prefix`` nearest pivots in order.
3. Two vectors are candidates if their prefixes share two pivots. Inverted lists are
   kept by pairs of pivots, so a list holds exactly vectors that share two, and its size
   falls with the square of the number of pivots. A pair is dealt with in the
   list of its two least shared pivots only.
4. Long lists are cut into blocks of about ``block`` vectors, and each pair of
   blocks is a unit of its own; no list, however hot, meets in one task.
5. Candidates are verified by cosine in double precision. A task returns links per
   vector and a spanning forest of its links, never the links themselves;
   components come from those forests.

The number of links of each vector is asked for, so a group of g unequal near vectors takes
g * g / 2 products; other vectors meet a few hundred each. Recall depends on the index alone; tests measure it
against brute force (0.99 and more, hot groups included).
Defined results: a vector without links has n_links 0 and is its own component;
vectors of other lengths than the most common one are compared among
their own length only; repeated vec_ids are counted as rows of their own in
n_links and reported once; rows without a vec_id link with nothing, have no
component_id and are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import components, lean, saved, text_bytes, whole_groups

PREFIX, BLOCK, SAMPLE, APART = 6, 2048, 8192, 0.8
#: Rows of a list up to which lists are dealt with many at a time.
SHORT = 32


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1, safe against overflow of squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first rows of x (unit vectors): each has the least cosine with the nearest one before it."""
    at, near = [0], x @ x[0]
    while len(at) < min(most, len(x)):
        i = int(near.argmin())
        if near[i] >= APART:
            break
        at.append(i)
        near = np.maximum(near, x @ x[i])
    return x[at]


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(n, prefix) nearest pivots in order; equal distances go by pivot number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _describe(pivots: dict[int, np.ndarray], prefix: int):
    """One row for each list (dim, two pivots) a vector is in."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, vec, size, dim = (batch.column(c) for c in ("v", "vec_id", "copies", "dim"))
            dims = dim.to_numpy()
            for d in np.unique(dims):
                whole = np.flatnonzero(dims == d)
                for at in range(0, len(whole), 2048):
                    own = whole[at : at + 2048]
                    raw = col.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
                    near = np.sort(permutations(_unit(raw.astype(float)), pivots[int(d)], prefix), axis=1).astype(np.int32)
                    a, b = np.triu_indices(near.shape[1], 1) if near.shape[1] > 1 else (np.zeros(1, int), np.zeros(1, int))
                    key = (np.int64(d) << 32) | (near[:, a].astype(np.int64) << 16) | near[:, b]
                    row = pa.array(np.repeat(np.arange(len(own)), len(a)))
                    blob = lambda z: pa.array([r.tobytes() for r in z], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.reshape(-1)), vec.take(pa.array(own)).take(row), size.take(pa.array(own)).take(row), blob(raw).take(row), blob(near).take(row),
                    ], ["key", "vec_id", "copies", "x", "near"])

    return run


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (of each node, the least of its component) after links a - b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _short(x: dict, unit: np.ndarray, near: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the short lists, all lists at once, by distance of their rows."""
    g, key = x["group"], x["key"]
    size = np.bincount(g)[g] if len(g) else g
    low, high = key >> 16 & 0xFFFF, key & 0xFFFF
    found = []
    for d in range(1, int(size[size <= SHORT].max(initial=0))):
        a = np.flatnonzero((size[:-d] <= SHORT) & (g[:-d] == g[d:]) & ((x["i"][:-d] == x["j"][:-d]) | (x["own"][:-d] != x["own"][d:])))
        for lo in range(0, len(a), 1 << 13):
            p = a[lo : lo + (1 << 13)]
            q = p + d
            p, q = (z[np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold] for z in (p, q))
            # the list of the two least shared pivots (sorted rows) deals with the pair
            shared = (near[p][:, :, None] == near[q][:, None, :]).any(axis=2) & (near[p] >= 0) & (near[p] < high[p][:, None]) & (near[p] != low[p][:, None])
            own = ~shared.any(axis=1)
            found.append((p[own], q[own]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))


def _long(x: dict, unit: np.ndarray, near: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one long list, or of two of its blocks, part by part. Rows that agree in the
    pivots below the list's own meet the rows that share none of these with them, all at once."""
    i, j, key = x["i"][rows[0]], x["j"][rows[0]], int(x["key"][rows[0]])
    low, high = key >> 16 & 0xFFFF, key & 0xFFFF
    below = np.where((near[rows] < high) & (near[rows] != low), near[rows], -1)
    kinds, kind = np.unique(below, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    side = x["own"][rows]
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for k in np.unique(kind[left]):
        pivots = kinds[k][kinds[k] >= 0]
        free = ~np.isin(kinds, pivots).any(axis=1)
        meet = right[free[kind[right]]]
        own = left[kind[left] == k]
        for at in range(0, len(own) if len(meet) else 0, 256):
            part = own[at : at + 256]
            ok = unit[rows[part]] @ unit[rows[meet]].T >= threshold
            if i == j:
                ok &= part[:, None] < meet[None]
            a, b = np.nonzero(ok)
            yield rows[part[a]], rows[meet[b]]


def _verify(threshold: float, kind: str):
    """Links per vector and a forest of them, of rows sorted by (key, i, j)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = "key", "i", "j", "own", "vec_id", "copies"
        for x in whole_groups(batches, numbers, ("x", "near"), ("key", "i", "j")):
            n = len(x["key"])
            unit, near = np.zeros((n, 0)), np.empty((n, PREFIX), np.int32)
            dims = x["key"] >> 32
            for d in np.unique(dims):  # rows are sorted by key, thus by dimension
                own = np.flatnonzero(dims == d)
                part = _unit(np.frombuffer(b"".join(x["x"][own[0] : own[-1] + 1]), kind).reshape(len(own), d).astype(float))
                if part.shape[1] > unit.shape[1]:
                    unit = np.concatenate([unit, np.zeros((n, part.shape[1] - unit.shape[1]))], axis=1)
                unit[own, :d] = part
                here = np.frombuffer(b"".join(x["near"][own[0] : own[-1] + 1]), np.int32).reshape(len(own), -1)
                if here.shape[1] > near.shape[1]:
                    near = np.concatenate([near, np.empty((n, here.shape[1] - near.shape[1]), np.int32)], axis=1)
                near[own] = -1 - np.arange(near.shape[1])  # few pivots: places of none
                near[own, : here.shape[1]] = here
            links, root = np.zeros(n, np.int64), np.arange(n)

            def count(a: np.ndarray, b: np.ndarray) -> None:
                nonlocal root
                links[:] += np.bincount(a, x["copies"][b], n).astype(np.int64) + np.bincount(b, x["copies"][a], n).astype(np.int64)  # noqa: B023
                root = joined(root, a, b)  # noqa: B023

            count(*_short(x, unit, near, threshold))
            bounds = np.flatnonzero(np.concatenate([[True], x["group"][1:] != x["group"][:-1], [True]]))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > SHORT:
                    for a, b in _long(x, unit, near, np.arange(lo, hi), threshold):
                        if len(a):
                            count(a, b)
            some = np.flatnonzero(links)
            hang = root[some] != some
            yield pa.RecordBatch.from_arrays([
                pa.array(x["vec_id"][some]), pa.array(links[some]), pa.array(x["vec_id"][root[some]], mask=~hang),
            ], ["vec_id", "links", "other"])

    return run


def _pivots(classes: DataFrame, most: int | None) -> dict[int, np.ndarray]:
    """Reference points by dimension, from one bounded sample of all dimensions."""
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not sizes:
        return {}
    total, span = sum(sizes.values()), 1 << 30
    keep = F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, int(min(1.0, max(SAMPLE / total, 64 / n)) * span))))
    got = classes.where(F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(span)) < keep[F.col("dim")]).select("dim", "vec_id", "v").collect()
    out = {}
    for d, n in sizes.items():
        x = _unit(np.array([r["v"] for r in sorted((r for r in got if r["dim"] == d), key=lambda r: r["vec_id"])], float))
        out[d] = choose_pivots(x, most or int(min(2048, max(128, 2 * n**0.5))))
    return out


def pivot_duplicates(vectors: DataFrame, threshold: float = 0.95, pivots: int | None = None, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding)."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    # -0.0 and 0.0 are one value, so equal vectors are equal keys
    rows = saved(v.select("vec_id", F.when(good, F.transform("v", lambda c: F.when(c == 0, F.abs(c)).otherwise(c))).alias("v")), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("dim", F.size("v")), "classes")
    listed = saved(classes.mapInArrow(_describe(_pivots(classes, pivots), prefix), "key long, vec_id long, copies long, x binary, near binary"), "lists")
    size = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = listed.join(size, "key").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    meet = own.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.withColumn("i", F.least("own", "peer")).withColumn("j", F.greatest("own", "peer")).select("key", "i", "j", "own", "vec_id", "copies", "x", "near")
    meet = meet.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = saved(meet.mapInArrow(_verify(threshold, kind), "vec_id long, links long, other long"), "verified")
    linked = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    label = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    # the members of each class get its links, plus one for each further copy
    per = classes.select("v", F.col("vec_id").alias("rep"), "copies")
    per = per.join(linked.select(F.col("vec_id").alias("rep"), "links"), "rep", "left").join(label.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
    out = rows.where("vec_id is not null").join(per, "v", "left")
    component = F.coalesce("component_id", "rep", "vec_id")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    out = out.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.min("kept").alias("kept"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)
