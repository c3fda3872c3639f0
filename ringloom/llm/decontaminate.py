"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. Items are partitioned by
their number of shingle runs into sizes (u/2, u], u a power of two, and by that of their distinct shingles into
(v/2, v]; but for items that repeat themselves v is u. For each
partition a document is cut into windows of 2u shingles that overlap by u, so
that an item lies whole in some window and a window is at most about four times
an item. Containment t of an item then means a Jaccard similarity of at least

    s = t * (v/2) / (2u + (1 - t) * v/2)

with that window, whatever the document's length, and single-row bands over

    b = ln(miss) / ln(1 - s)

MinHash functions miss it with probability ``miss`` at most. A window whose
minimum under any function equals the item's is a candidate. Candidates are
verified by exact containment of the item's shingle set in the whole document.

The items, not the documents, are indexed and sent to all executors, in blocks
of at most ``block_items`` items and ``block_bytes`` bytes of text; a larger
benchmark is searched block by block, each against all documents. Nothing is
shuffled; each task holds a few MB of text at once.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters. Defined results: an item of fewer than k words is one shingle of all
its words; items and documents without words match nothing; repeated rows
give a pair each; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import GOLD, LOWER, PUNCT, pieces, shingles, text_bytes, word_hashes, word_spans

SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def bands(u: int, v: int, t: float, miss: float) -> int:
    """MinHash functions needed by the partition of (u/2, u] runs and (v/2, v] distinct shingles."""
    q, w = max(1.0, v / 2), 2.0 * u
    s = t * q / (w + (1 - t) * q)
    return max(1, math.ceil(math.log(miss) / math.log(1 - s)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(41)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(col: pa.Array):
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, PUNCT)
    return word_hashes(data, starts, ends), first


def index(texts: list[str | None], k: int, t: float, miss: float) -> dict:
    """{(width, u, v): minima per function, sorted, and their items}, and each item's set."""
    words, first = _words(pa.array(texts, pa.large_string()))
    counts = np.diff(first)
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    parts: dict[tuple[int, int, int], list[int]] = {}
    power = lambda n: 1 << max(0, int(n - 1).bit_length())
    for i, n in enumerate(counts):
        if n:
            width = int(min(k, n))
            h, _ = shingles(words[first[i] : first[i + 1]], np.array([0, n]), width)
            sets[i] = np.unique(h)
            parts.setdefault((width, power(len(h)), power(len(sets[i]))), []).append(i)
    out = {}
    for (width, u, v), own in parts.items():
        n = bands(u, v, t, miss)
        add, mul = _functions(n)
        low = np.stack([((sets[i][:, None] ^ add) * mul).min(axis=0) for i in own])
        order = np.argsort(low, axis=0, kind="stable")
        out[width, u, v] = [(np.take_along_axis(low, order, 0)[:, f], np.array(own)[order[:, f]]) for f in range(n)]
    return {"parts": out, "sets": sets}


def candidates(h: np.ndarray, begin: np.ndarray, u: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
    """(row, item) pairs of which some window shares a minimum."""
    n = np.diff(begin)
    rows = np.flatnonzero(n)
    if not len(rows):
        return set()
    blocks = -(-n[rows] // u)
    row = np.repeat(rows, blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[row] + nth * u
    joined = np.flatnonzero(row[1:] == row[:-1])
    add, mul = _functions(len(tables))
    found = set()
    for f, (low, item) in enumerate(tables):
        m = np.minimum.reduceat((h ^ add[f]) * mul[f], at)
        w = m.copy()
        w[joined] = np.minimum(m[joined], m[joined + 1])
        lo = np.searchsorted(low, w, "left")
        hit = np.flatnonzero(low[np.minimum(lo, len(low) - 1)] == w)
        for i in hit:
            hi = np.searchsorted(low, w[i], "right")
            found.update((int(row[i]), int(x)) for x in item[lo[i] : hi])
    return found


def _search(ids: list[int | None], idx: dict, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, first = _words(part.column("text"))
                doc, rows = part.column("doc_id").to_pylist(), []
                for width in sorted({w for w, _, _ in idx["parts"]}):
                    h, begin = shingles(words, first, width)
                    keep = np.diff(first) >= width
                    pairs = set()
                    for (w, u, _), tables in idx["parts"].items():
                        if w == width:
                            pairs |= candidates(h, begin, u, tables)
                    sets: dict[int, np.ndarray] = {}
                    for r, i in sorted(pairs):
                        if not keep[r]:
                            continue  # fewer words than the item's shingles
                        if r not in sets:
                            sets[r] = np.unique(h[begin[r] : begin[r + 1]])
                        own = idx["sets"][i]
                        n = int(np.isin(own, sets[r], assume_unique=True).sum())
                        if n >= t * len(own) - 1e-9:
                            rows.append((doc[r], ids[i], len(own), n, n / len(own)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def _blocks(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[list]:
    own, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        own.append(r)
        size += len(r[1] or "")
        if len(own) >= block_items or size >= block_bytes:
            yield own
            own, size = [], 0
    if own:
        yield own


def contained(docs: DataFrame, items: DataFrame, k: int = 5, t: float = 0.8, miss: float = 1e-4, block_items: int = 20_000, block_bytes: int = 8_000_000) -> DataFrame:
    """One row (doc_id, item_id, n_item, n_shared, containment) for each document
    that holds at least the share t of an item's distinct shingles."""
    spark, found = docs.sparkSession, []
    for block in _blocks(items, block_items, block_bytes):
        idx = index([r[1] for r in block], k, t, miss)
        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search([r[0] for r in block], idx, t), SCHEMA))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], SCHEMA)


def contained_sql(k: int = 5, percent: int = 80) -> str:
    """DuckDB SQL of contained() by plain joins of all shingles."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text,''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with i as (select item_id, {words} as w from benchmark),
i2 as (select item_id, w, least({k}, len(w)) as k from i where len(w) > 0),
s as (select distinct item_id, k, array_to_string(w[j:j+k-1], ' ') as g from (select *, unnest(range(1, len(w)-k+2)) as j from i2)),
n as (select item_id, count(*) as n_item from s group by item_id),
d as (select doc_id, {words} as w from documents),
dk as (select distinct doc_id, q.k, w from d, (select distinct k from i2) q where len(w) >= q.k),
ds as (select distinct doc_id, k, array_to_string(w[j:j+k-1], ' ') as g from (select *, unnest(range(1, len(w)-k+2)) as j from dk)),
m as (select doc_id, item_id, count(*) as n_shared from ds join s using (k, g) group by all)
select doc_id, item_id, n_item::bigint as n_item, n_shared::bigint as n_shared, n_shared / n_item as containment
from m join n using (item_id) where 100 * n_shared >= {percent} * n_item"""
