"""Near-duplicate texts by one-permutation MinHash with optimal densification.

1. Every text becomes the set of its distinct k-word shingles (64-bit hashes).
   Each set is hashed once; its values fall into ``bins`` ranges of which each
   keeps the least. An empty bin borrows from a filled one that an own universal
   hash of (bin, attempt) points at (optimal densification), so that the
   signature collides with the Jaccard similarity in every bin.
2. Texts with equal sets are one class, told by a 128-bit sum over the set; only
   the class's smallest doc_id goes on.
3. ``rows`` bins make a band; a bucket holds the classes that agree in a band.
   A bucket emits a star: each member with the bucket's hub, so that candidates
   grow as the bucket, not as its square. The hub is the member that meets most
   others in its buckets, thus the one nearest to the middle of its family. Pairs
   whose sizes alone exclude the similarity go.
4. Pairs are confirmed on full sets: ``100 * intersection >= percent * union``
   in integers. The sets of bucket members, made from the texts in one pass through
   a bitmap of fixed size, travel once a pair; a hub's set travels once
   for some hundreds of its pairs, which also deals out a hot hub.
5. Links become components. Buckets whose members still lie in several
   components get two more stars, around the hubs of their two largest components.
6. The rest is exact. In every bucket that still holds several components, all
   pairs across components are tested, in blocks, but for the pairs inside the
   bucket's largest component. A test that excludes is a proof: with c[r]
   the number of a set's values in range r of the hash, the intersection is at most the
   sum of the lesser counts. The few pairs that it lets through are confirmed on full
   sets, the likeliest ones of two components first; the others follow unless those
   have joined the two. So every pair that shares a bucket is linked, excluded, or inside a component.

Similarity 0.8 with 6 rows and 42 bands misses a pair in all bands with
probability (1 - 0.8 ** 6) ** 42 = 3e-6; nothing else is missed. Step 6 costs, for a bucket of n
members of which m lie outside its largest component, about n * m tests of a
few dozen bytes. Defined results: null, empty and blank
texts have an empty set and stay alone; texts of fewer words than k are one
shingle; repeated rows of a doc_id are one document with the links of each of
its texts and the smallest of their n_shingles; rows without a doc_id link with
nothing, have no component_id and are kept; extra
columns are ignored; empty input, empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import GOLD, LOWER, SPACE, components, done, lean, mix, pieces, row_sets, saved, shingles, text_bytes, whole_groups, word_hashes, word_spans

ROWS, BANDS = 6, 42
#: Ranges of a sketch and of its summary; members of a block; pairs that a copy of a hub's set serves.
RANGES, COARSE, BLOCK, FAN = 256, 16, 512, 512
#: Bits of the bitmap that says which texts are candidates; 2 MB at any input size.
BITMAP = 1 << 24


def text_shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, SPACE)
    return shingles(word_hashes(data, starts, ends), first, k)


def _donors(bins: int, tries: int = 64) -> np.ndarray:
    """donor[t, j]: the bin that empty bin j asks at attempt t, alike for all sets."""
    at = np.arange(tries * bins, dtype=np.uint64).reshape(tries, bins)
    return (mix(at * np.uint64(GOLD) + np.uint64(77)) >> np.uint64(33)).astype(np.int64) % bins


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(n, bins) one-permutation signatures; an empty set has zeros."""
    out = np.zeros((len(sets), bins), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    h = mix(np.concatenate(sets) ^ np.uint64(0xA5A5F00DCAFE1234))
    row = np.repeat(np.arange(len(sets)), sizes)
    slot = row * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((h, slot))
    slot, h = slot[order], h[order]
    lead = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    filled = np.zeros(len(sets) * bins, bool)
    filled[slot[lead]] = True
    out.reshape(-1)[slot[lead]] = h[lead]
    filled = filled.reshape(out.shape)
    own, donors = out.copy(), _donors(bins)
    todo = ~filled & (sizes > 0)[:, None]
    for t in range(len(donors)):
        if not todo.any():
            break
        r, j = np.nonzero(todo)
        ok = filled[r, donors[t, j]]
        out[r[ok], j[ok]] = mix(own[r[ok], donors[t, j[ok]]] + np.uint64(t + 1))
        todo[r[ok], j[ok]] = False
    for r, j in zip(*np.nonzero(todo), strict=True):  # no attempt met a filled bin: the nearest one
        near = np.flatnonzero(filled[r])
        out[r, j] = mix(own[r, near[np.argmin((near - j) % bins)]][None] + np.uint64(len(donors) + 1))[0]
    return out


def _sign(k: int, rows: int, bands: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets = row_sets(*text_shingles(part.column("text"), k))
                sig = signatures(sets, rows * bands).reshape(len(sets), bands, rows)
                keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(sets), 1))
                for j in range(rows):
                    keys = mix(keys * np.uint64(GOLD) + sig[:, :, j])
                prints = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(GOLD)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64))),
                ], ["doc_id", "n_shingles", "fp1", "fp2", "keys"])

    return run


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(n, RANGES) numbers of values in each range of the hash, 255 for more."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = row * RANGES + (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sets) * RANGES), 255).astype(np.uint8).reshape(len(sets), RANGES)


def _sets(k: int, bitmap: bytes):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("slot").to_numpy()].astype(bool)))
            for lo, hi in pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets = row_sets(*text_shingles(part.column("text"), k))
                rows = pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([c.tobytes() for c in sketches(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *rows], ["doc_id", "shingles", "sketch"])

    return run


def _members(bitmap: bytes):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        for batch in batches:
            keys, slots = (batch.column(c).flatten().to_numpy() for c in ("keys", "slots"))
            row = np.repeat(np.arange(batch.num_rows), len(keys) // max(1, batch.num_rows))
            ok = bits[slots].astype(bool)
            row = row[ok]
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(batch.column("doc_id").to_numpy()[row]), pa.array(batch.column("n_shingles").to_numpy()[row])], ["key", "doc_id", "n_shingles"])

    return run


def _only(bitmap: bytes):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("slot").to_numpy()].astype(bool)))

    return run


def _confirm(percent: int):
    """Pairs (x, y) that are similar, of rows sorted by (x, salt): the set of x, without y, and
    behind it those of its ys."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            data, off = text_bytes(batch.column("shingles"))
            data, off = data.view(np.uint64), off // 8
            lead = np.flatnonzero(batch.column("y").is_null().to_numpy(zero_copy_only=False))
            ok = np.zeros(batch.num_rows, bool)
            for at, end in zip([-1, *lead.tolist()], [*lead.tolist(), batch.num_rows], strict=True):
                if at >= 0:
                    hub = data[off[at] : off[at + 1]].copy()
                if end == at + 1:
                    continue
                own = data[off[at + 1] : off[end]]
                hit = hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own
                inter = np.add.reduceat(hit.astype(np.int64), off[at + 1 : end] - off[at + 1])
                ok[at + 1 : end] = 100 * inter >= percent * (len(hub) + np.diff(off[at + 1 : end + 1]) - inter)
            yield batch.select(["x", "y"]).filter(pa.array(ok)).rename_columns(["a", "b"])

    return run


COLS = "key", "i", "j", "own", "doc_id", "first", "now", "n_shingles"


def _pair_tests(x: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs across components (``first``) of each group (key, i, j) that the sketches do not
    exclude. A group's rows stand together; ``own`` tells the block i or j they are of."""
    n, g = x["n_shingles"], x["group"]
    fits = lambda a, b: (x["first"][a] != x["first"][b]) & ((x["i"][a] == x["j"][a]) | (x["own"][a] != x["own"][b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    # intersection <= (|a| + |b| - distance of the sketches) / 2
    most = lambda a, b: ((100 - percent) * (n[a] + n[b])) // (100 + percent)
    far = lambda s, a, b: np.abs(s[a] - s[b]).sum(axis=-1, dtype=np.int64)
    fine, coarse = x["sketch"].astype(np.int16), x["sketch"].reshape(len(n), COARSE, -1).sum(axis=2, dtype=np.int32)
    bounds = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    size = np.diff(bounds)
    small = np.repeat(size <= 32, size)
    out = []

    def test(a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(a), 1 << 13):
            p, q = a[lo : lo + (1 << 13)], b[lo : lo + (1 << 13)]
            top = most(p, q)
            ok = far(coarse, p, q) <= top
            p, q, top = p[ok], q[ok], top[ok]
            ok = far(fine, p, q) <= top
            out.append((p[ok], q[ok]))

    for d in range(1, int(size[size <= 32].max(initial=0))):  # small groups, all at once
        a = np.flatnonzero(small[:-d] & (g[:-d] == g[d:]))
        a = a[fits(a, a + d)]
        test(a, a + d)
    for lo, hi in zip(bounds[:-1][size > 32], bounds[1:][size > 32], strict=True):
        own = np.arange(lo, hi)
        same = x["i"][lo] == x["j"][lo]
        left, right = (own, own) if same else (own[x["own"][own] == x["i"][lo]], own[x["own"][own] != x["i"][lo]])
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            ok = fits(part[:, None], right[None])
            if same:
                ok &= part[:, None] < right[None]
            a, b = np.nonzero(ok)
            test(part[a], right[b])
    return tuple(np.concatenate([np.zeros(0, np.int64), *[o[i] for o in out]]) for i in (0, 1))


def _cross(percent: int, low: int, high: int):
    """The pairs that sketches do not exclude, of each two components in a group those ranked
    low to high - 1 by likelihood; ``more`` tells that others are left."""

    def tested(x: dict) -> pa.RecordBatch:
        a, b = _pair_tests(x, percent)
        far = np.abs(x["sketch"][a].astype(np.int16) - x["sketch"][b]).sum(axis=1) if len(a) else np.zeros(0)
        near = -far / (x["n_shingles"][a] + x["n_shingles"][b])
        c, d = np.minimum(x["first"][a], x["first"][b]), np.maximum(x["first"][a], x["first"][b])
        order = np.lexsort((x["doc_id"][b], x["doc_id"][a], -near, d, c, x["group"][a]))
        a, b, c, d = a[order], b[order], c[order], d[order]
        g = x["group"][a]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(a) else np.zeros(0, bool)
        lead = np.flatnonzero(fresh)
        size = np.diff(np.append(lead, len(a)))
        rank = np.arange(len(a)) - np.repeat(lead, size)
        use = (rank >= low) & (rank < high) & (x["now"][a] != x["now"][b])
        return pa.RecordBatch.from_arrays([pa.array(x["doc_id"][a[use]]), pa.array(x["doc_id"][b[use]]), pa.array(np.repeat(size > high, size)[use])], ["x", "y", "more"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, COLS, ("sketch",), ("key", "i", "j")):
            x["sketch"] = np.frombuffer(b"".join(x["sketch"]), np.uint8).reshape(-1, RANGES)
            yield tested(x)

    return run


def _slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BITMAP))


def _bitmap(values: DataFrame) -> bytes:
    """Which slots the values of the only column fall in; at most BITMAP / 8 bytes reach the driver."""
    slot = values.select((_slot(values.columns[0]) + 1).alias("slot"))  # bit positions count from 1
    out = bytearray(BITMAP // 8)
    parts = slot.groupBy(F.bitmap_bucket_number("slot").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in parts.collect():
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = r["bits"]
    return bytes(out)


def member_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles, sketch) of the documents ids names, and of few others."""
    found = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text", _slot("doc_id").alias("slot"))
    return found.mapInArrow(_sets(k, _bitmap(ids)), "doc_id long, shingles binary, sketch binary")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (x, y) whose full shingle sets are similar enough, as (a, b).

    Pairs meet by x, the hub, in groups of about FAN; a group has its hub's set once."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id"))
    sets = sets.select("doc_id", "shingles", _slot("doc_id").alias("slot"))
    sets = sets.mapInArrow(_only(_bitmap(ids)), "doc_id long, shingles binary, slot long").drop("slot")
    fan = pairs.groupBy("x").agg(F.ceil(F.count("*") / FAN).alias("fan"))
    dealt = pairs.join(fan, "x").select("x", F.pmod(F.xxhash64("y"), F.col("fan")).alias("salt"), "y")
    hubs = fan.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("salt"), F.lit(None).cast("long").alias("y"))
    hubs = hubs.join(sets.withColumnRenamed("doc_id", "x"), "x").select("x", "salt", "y", "shingles")
    others = dealt.join(sets.withColumnRenamed("doc_id", "y"), "y").select("x", "salt", "y", "shingles")
    rows = hubs.union(others).repartition("x", "salt").sortWithinPartitions("x", "salt", F.asc_nulls_first("y"))
    return rows.mapInArrow(_confirm(percent), "a long, b long")


def near_links(signed: DataFrame, docs: DataFrame, k: int, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, label): classes has doc_id, n_shingles and rep, the
    smallest doc_id with an equal set; links has confirmed pairs (a, b) of reps, enough
    of them to join every component; label has (node, component_id) of the reps that have links."""
    docs = docs.where(F.col("doc_id").isNotNull())
    signed = signed.where(F.col("doc_id").isNotNull())
    reps = signed.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    classes = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(reps, ["n_shingles", "fp1", "fp2"], "left")
    rep = F.coalesce("rep", "doc_id")
    classes = saved(classes.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"), F.min(rep).alias("rep"), F.max("rep").alias("high")), "classes")
    # texts of one doc_id are one document: their classes are linked as they are
    twice = signed.join(classes.where("rep <> high").select("doc_id", F.col("rep").alias("a")), "doc_id").join(reps, ["n_shingles", "fp1", "fp2"])
    same = twice.select("a", F.col("rep").alias("b")).where("a <> b")
    classes = classes.drop("high")

    banded = signed.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    banded = saved(banded.select("doc_id", "n_shingles", "keys"), "banded")
    # keys of several classes; a bitmap of them lets the lone rows, nearly all, stay behind
    size = saved(banded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    slots = banded.withColumn("slots", F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(BITMAP)).cast("int")))
    members = slots.mapInArrow(_members(_bitmap(size.select("key"))), "key long, doc_id long, n_shingles long")
    members = saved(members.join(size, "key"), "met")
    done(banded)
    weight = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    members = saved(members.drop("n").join(weight, "doc_id"), "buckets")
    sets = saved(member_sets(docs, weight.select("doc_id"), k), "sets")

    pairs = saved(_stars(members, percent), "stars")
    links = saved(confirmed(sets, pairs, percent).union(same), "confirmed")
    label = components(links)
    more = saved(_second_stars(_labelled(members, label), percent).join(pairs, ["x", "y"], "left_anti"), "stars")
    fresh = saved(confirmed(sets, more, percent), "confirmed")
    if not fresh.isEmpty():
        links, label = links.union(fresh), components(_tied(label).union(fresh))

    left = saved(_mixed(_labelled(members, label)), "mixed")
    low, high = 0, 16
    while not left.isEmpty():
        blocks = _blocks(left, label, sets).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = saved(blocks.mapInArrow(_cross(percent, low, high), "x long, y long, more boolean"), "crossed")
        fresh = saved(confirmed(sets, found.select("x", "y").distinct(), percent), "confirmed")
        if not fresh.isEmpty():
            links, label = links.union(fresh), components(_tied(label).union(fresh))
        if found.where("more").isEmpty():
            break
        low, high = high, 16 * high
    return classes, links, label


def _tied(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("a"), F.col("component_id").alias("b"))


def _labelled(members: DataFrame, label: DataFrame, name: str = "c") -> DataFrame:
    """members with the component of each."""
    m = members.join(label.select(F.col("node").alias("doc_id"), "component_id"), "doc_id", "left")
    return m.withColumn(name, F.coalesce("component_id", "doc_id")).drop("component_id")


def _star(m: DataFrame, percent: int) -> DataFrame:
    """(x, y) of rows with a hub (doc_id, n_shingles), where the set sizes allow the similarity."""
    n = F.col("hub.n_shingles")
    near = F.least(n, "n_shingles") * 100 >= F.greatest(n, "n_shingles") * percent
    return m.where(near & (F.col("hub.doc_id") != F.col("doc_id"))).select(F.col("hub.doc_id").alias("x"), F.col("doc_id").alias("y"))


def _middle() -> Column:
    return F.max(F.struct("weight", (-F.col("doc_id")).alias("r"), "doc_id", "n_shingles"))


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """First candidates: one star a bucket."""
    hubs = members.groupBy("key").agg(_middle().alias("hub"))
    return _star(members.join(hubs, "key"), percent).distinct()


def _parts(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, c) with its members and hub; and for each key of several components
    n, its members, and main, the largest one."""
    parts = m.groupBy("key", "c").agg(F.count("*").alias("cnt"), _middle().alias("hub"))
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("cnt").alias("n"), F.max(F.struct("cnt", (-F.col("c")).alias("r"), "c", "hub")).alias("main"))
    return parts, keys.where("parts > 1").drop("parts")


def _second_stars(m: DataFrame, percent: int) -> DataFrame:
    """Stars around the hubs of the two largest components of buckets that have several."""
    m = saved(m, "labelled")
    parts, keys = _parts(m)
    main = keys.select("key", F.col("main.c").alias("own"), F.col("main.hub").alias("hub"))
    other = parts.join(main.select("key", "own"), "key").where("c <> own").groupBy("key").agg(F.max(F.struct("cnt", (-F.col("c")).alias("r"), "c", "hub")).alias("o"))
    hubs = main.union(other.select("key", F.col("o.c").alias("own"), F.col("o.hub").alias("hub")))
    return _star(m.join(hubs, "key").where("c <> own"), percent).distinct()


def _mixed(m: DataFrame) -> DataFrame:
    """Members of buckets with several components, and where they stand: ``own`` is one of
    ``rest`` + ``mains`` blocks, the first ``rest`` of which hold what is not of the
    bucket's largest component."""
    m = saved(m.withColumnRenamed("c", "first"), "labelled")
    _, keys = _parts(m.withColumnRenamed("first", "c"))
    m = m.join(keys.select("key", "n", F.col("main.c").alias("largest"), F.col("main.cnt").alias("cnt")), "key")
    one, count = F.col("n") <= BLOCK, lambda c: F.ceil(c / BLOCK).cast("int")
    m = m.withColumn("rest", F.when(one, 1).otherwise(count(F.col("n") - F.col("cnt")))).withColumn("mains", F.when(one, 0).otherwise(count(F.col("cnt"))))
    h = F.xxhash64("doc_id", F.lit(3))
    own = F.when(one, 0).when(F.col("first") != F.col("largest"), F.pmod(h, F.col("rest"))).otherwise(F.col("rest") + F.pmod(h, F.col("mains")))
    return m.select("key", "doc_id", "n_shingles", "first", "rest", "mains", own.cast("int").alias("own"))


def _blocks(left: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of every two blocks that meet: each block of the rest with all others and itself."""
    m = _labelled(left, label, "now")
    several = m.groupBy("key").agg(F.min("now").alias("a"), F.max("now").alias("b")).where("a < b").select("key")
    m = m.join(several, "key", "left_semi").join(sets.select("doc_id", "sketch"), "doc_id")
    last = F.when(F.col("own") < F.col("rest"), F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1
    m = m.withColumn("peer", F.explode(F.sequence(F.lit(0), last)))
    return m.select("key", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), "own", "doc_id", "first", "now", "n_shingles", "sketch")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per doc_id, and every row without one."""
    docs = docs.select("doc_id", "text")
    signed = saved(docs.mapInArrow(_sign(k, rows, bands), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>"), "signed")
    classes, _, label = near_links(signed, docs, k, percent)
    out = classes.join(label.select(F.col("node").alias("rep"), F.col("component_id").alias("c")), "rep", "left").withColumn("component_id", F.coalesce("c", "rep"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)
