"""Shared plumbing of the corpus operators: tables, shared storage, hashing of
UTF-8 bytes with numpy, and connected components of link tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
GOLD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from now on import this package, and keeps the Arrow
    batches that go to them small unless the session says otherwise."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_of(spark.conf.get(key)) > 1 << 26:
        spark.conf.set(key, "2m")
    return spark


def size_of(text: str) -> int:
    """A size as Spark's settings write it, in bytes."""
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}
    text = text.strip().lower().rstrip("b")
    return int(text[:-1]) << unit[text[-1]] if text[-1:] in unit else int(text)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where the session
    names none (tests, one machine) a temporary folder takes its place."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ringloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while it lasts."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "2m"):
    """Arrow batches of at most ``size`` while it lasts: long texts and sets are held
    by the JVM and a Python worker at once, whose memory is small."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run):
    """A function over Arrow batches that gives freed memory back to the system when it
    ends: its worker lives on beside those of later stages."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts
    the lineage: a lost executor costs a re-read, not a recomputation. The shuffle files made for it go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ringloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(dropped, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session still lives."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the shared folder is the cluster's to clear
        pass


def done(df: DataFrame) -> None:
    """Removes the folder of a table that saved() gave and nothing reads any more."""
    files = df.inputFiles()
    if files:
        dropped(df.sparkSession, os.path.dirname(files[0]))


#: Bits of the bitmap of without(); 2 MB at any input size.
BITMAP = 1 << 24


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in gone (doc_id); null ids stay.

    Texts are not shuffled for it: a bitmap of fixed size clears nearly all rows
    that stay, and only the rest meets the ids themselves."""
    spark = docs.sparkSession
    gone = saved(gone.select(F.col("doc_id").cast("long").alias("_gone")), "gone")
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITMAP)) + 1
    bits = gone.select(slot("_gone").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    bits = spark.createDataFrame(bits.collect(), "_n long, _bits binary")
    maybe = free_name(docs, "_maybe")
    n, held = free_name(docs, "_n"), free_name(docs, "_bits")
    bits = bits.withColumnsRenamed({"_n": n, "_bits": held})
    at = F.bitmap_bit_position(slot("doc_id"))
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1)
    flagged = docs.join(F.broadcast(bits), F.bitmap_bucket_number(slot("doc_id")) == F.col(n), "left").withColumn(maybe, F.coalesce(set_ == 1, F.lit(False)))
    stay = flagged.where(~F.col(maybe)).select(*docs.columns)
    rest = flagged.where(F.col(maybe)).select(*docs.columns)
    return stay.union(rest.join(gone, rest["doc_id"] == gone["_gone"], "left_anti"))


# --- UTF-8 bytes in numpy -------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but ASCII digits, ASCII letters and bytes of non-ASCII characters.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = PUNCT[128:] = False


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not wide and not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    bufs = col.buffers()
    if not len(col) or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(col: pa.Array, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes, so that work arrays stay small; a
    longer single text makes a range of its own."""
    _, off = text_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray):
    """Starts and ends of maximal runs without separator bytes, none across
    rows, and for each row the index of its first word (n + 1 numbers)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~sep[data]
    first = np.empty(len(w), bool)
    first[0], first[1:] = True, ~w[:-1]
    first[off[:-1][off[:-1] < len(w)]] = True
    last = np.empty(len(w), bool)
    last[-1], last[:-1] = True, first[1:] | ~w[1:]
    starts, ends = np.flatnonzero(w & first), np.flatnonzero(w & last) + 1
    return starts, ends, np.searchsorted(starts, off)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x5851F42D4C957F2D)
_PI = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, key: str, n: int) -> np.ndarray:
    got = _pow.get(key)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.empty(size, np.uint64)
        got[0], k = 1, 1
        while k < size:
            step = np.uint64(pow(int(base), k, 1 << 64))
            got[k : 2 * k] = got[:k] * step
            k *= 2
        if size <= 1 << 23:
            _pow[key] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array, not in place."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span: differences of a running polynomial sum, made
    over about ``most`` bytes at a time; it does not depend on where a span stands."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        lo, own = starts[i], data[starts[i] : ends[j - 1]]
        s, e = starts[i:j] - lo, ends[i:j] - lo
        acc = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * _powers(_P, "p", len(own))[: len(own)], out=acc[1:])
        out[i:j] = mix((acc[e] - acc[s]) * _powers(_PI, "i", len(own))[s] + (e - s).astype(np.uint64) * np.uint64(GOLD))
        i = j
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, and for each row the index of its first one.
    A row of fewer words, but at least one, has its whole sequence as the only run."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    short = np.repeat(np.minimum(counts, k), n)
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        inside = short > j
        nxt = words[np.minimum(at + j, len(words) - 1)]
        h = np.where(inside, mix(h * np.uint64(GOLD) + nxt), h)
    return h, begin


def row_sets(h: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    return [np.unique(h[begin[i] : begin[i + 1]]) for i in range(len(begin) - 1)]


# --- rows that stand together --------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], numbers: tuple, blobs: tuple, keys: tuple) -> Iterator[dict]:
    """Columns of whole groups (``keys``), some at a time, of rows sorted by them: arrays of the
    ``numbers``, lists of bytes of the ``blobs``, and ``group``, counted from 0 in each part. A group may
    go on in the next batch, so the one met last waits for it; at most a batch and a group are held."""
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: batch.column(c).to_numpy() for c in numbers} | {c: batch.column(c).to_pylist() for c in blobs}
        if held:
            x = {c: held[c] + v if c in blobs else np.concatenate([held[c], v]) for c, v in x.items()}
        fresh = np.zeros(len(x[keys[0]]), bool)
        for c in keys:
            fresh[1:] |= x[c][1:] != x[c][:-1]
        last = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
        if last:
            yield {c: v[:last] for c, v in x.items()} | {"group": np.cumsum(fresh[:last])}
        held = {c: v[last:] for c, v in x.items()}
    if held:
        yield held | {"group": np.zeros(len(held[keys[0]]), np.int64)}


# --- links ------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) of every node with an edge; component_id is the
    smallest node id reachable.

    Alternates large-star and small-star steps: each round hangs a node's larger
    neighbours, then its smaller ones, on its smallest neighbour, until every
    component is one star. Rounds grow with the logarithm of the longest path; a
    round is two aggregations (combined map-side) and two joins that AQE may
    split, and ends as a table in the shared folder. Self edges are ignored."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        # stars: every node hangs on one other, which hangs on none
        twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if twice.union(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).isEmpty():
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
