"""Best-fit packing of tokenised documents by fitted length patterns.

1. Tokenise: each document's ids, then one end id. Words between ASCII white
   space are encoded alone and kept, as written, in a bounded cache; the vocabulary's
   pre-tokenizer never joins across white space, so ids equal those of the whole
   text. New words of Latin letters are cut into runs here and only merged by the vocabulary. Documents over ``cap`` ids are cut into pieces of ``cap``.
2. Only the histogram of piece lengths (at most ``cap`` numbers) reaches the
   driver. Patterns of a few lengths that fill ``cap`` exactly are enumerated
   from it, their repeat counts fitted by non-negative least squares (coordinate
   descent), rounded down, and the residual histogram is packed best-fit
   decreasing, whole groups of equal bins at a time. The cost depends on ``cap``,
   not on the number of documents.
3. The plan is a table of intervals: the pieces of one length with ranks lo..hi
   take slot j of one recipe. Ranks within a length are made from counts of
   (length, salt) groups, so that no length, however common, meets in one task.

Defined results: null and empty texts are one piece of the end id; repeated rows
are packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import lean, pieces, saved

CAP = 2048
CACHE = 100_000  # words of a generation; a worker keeps the newest and the one before it
#: Printable ASCII and the letters of Latin-1: normal forms of one code point, lower-cased one to one.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokenizer's pattern as far as lower-case words of PLAIN go.
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level alphabet: a byte that Latin-1 prints is itself, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SELF}))}


class _Words(dict):
    """Little-endian 32-bit ids of words as they are written, made when first asked for."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.model = self.tok.model
        self.before: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word)
        if out is None:
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                # cut as the vocabulary's own pre-tokenizer does; each run is one call of its merges
                get = self.runs.get
                out = b"".join([get(r) or self._run(r) for r in RUNS.findall(text.lower())])
            else:
                out = array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out

    def _run(self, run: str) -> bytes:
        mapped = run if run.isascii() else "".join([_BYTES[b] for b in run.encode()])
        out = self.runs[run] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return out

    def age(self) -> None:
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()
        if len(self.runs) > CACHE:
            self.runs.clear()


@lru_cache(maxsize=2)
def _encoder(spec: str) -> _Words:
    return _Words(spec)


def encode(texts: list[bytes], spec: str) -> list[bytes]:
    """Little-endian 32-bit ids of each UTF-8 text, equal to encoding whole texts."""
    words = _encoder(spec)
    words.age()
    get = words.__getitem__
    # special tokens, which are matched as written, may hold no blank, so words may be encoded alone
    return [b"".join(map(get, t.split())) for t in texts]


def _pieces(spec: str, cap: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                doc, piece, length, crc, ids = [], [], [], [], []
                for d, raw in zip(part.column("doc_id").to_pylist(), encode(texts, spec), strict=True):
                    raw += tail
                    for n, at in enumerate(range(0, len(raw), 4 * cap)):
                        own = raw[at : at + 4 * cap]
                        doc.append(d), piece.append(n), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array([n * cap for n in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, cap: int = CAP, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary,
    little-endian 32 bits each) of every piece. tokenizer: path of a tokenizers file,
    read on the driver."""
    spec = Path(tokenizer).read_text(encoding="utf-8")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(spec, cap, end, with_ids), schema)


# --- the plan ----------------------------------------------------------------


def patterns(hist: np.ndarray, most: int = 4000, longest: int = 8, seed: int = 7) -> list[tuple[int, ...]]:
    """Distinct patterns of at most ``longest`` lengths that the histogram holds
    and that add up to the cap exactly: every pair, then patterns drawn by the
    histogram's own weights whose last length is the exact rest."""
    cap = len(hist) - 1
    there = np.flatnonzero(hist[:cap])
    out = {(int(a), cap - int(a)) for a in there if 2 * a >= cap and hist[cap - a]}
    if not len(there):
        return sorted(out)
    p = hist[there] / hist[there].sum()
    draws = np.random.default_rng(seed).choice(there, size=(8 * most, longest - 1), p=p)
    for row in draws:
        rest, own = cap, []
        for x in row:
            if hist[rest] and own:
                break
            if x < rest:
                own.append(int(x))
                rest -= int(x)
        if own and rest < cap and hist[rest]:
            out.add(tuple(sorted((*own, rest), reverse=True)))
        if len(out) >= most:
            break
    return sorted(out, reverse=True)


def fit(hist: np.ndarray, pats: list[tuple[int, ...]], sweeps: int = 40) -> list[float]:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns'
    lengths from the histogram, by cyclic coordinate descent."""
    rest = hist.astype(float).tolist()
    cols = [[(n, p.count(n)) for n in sorted(set(p))] for p in pats]
    norm = [sum(m * m for _, m in c) for c in cols]
    x = [0.0] * len(pats)
    for _ in range(sweeps):
        for i, c in enumerate(cols):
            step = 0.0
            for n, m in c:
                step += m * rest[n]
            step = max(step / norm[i], -x[i])
            if step:
                x[i] += step
                for n, m in c:
                    rest[n] -= m * step
    return x


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a bin, number of such bins)."""
    cap = len(hist) - 1
    rooms: list[int] = []  # sorted distinct free spaces
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(own: tuple[int, ...], free: int, n: int) -> None:
        if not free:
            done.append((own, n))
        elif free in groups:
            groups[free].append((own, n))
        else:
            groups[free] = [(own, n)]
            insort(rooms, free)

    for size in range(cap, 0, -1):
        left = int(hist[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                own, bins, free = (), -(-left // (cap // size)), cap
            else:
                free = rooms[at]
                own, bins = groups[free].pop()
                if not groups[free]:
                    del groups[free], rooms[at]
            each = free // size
            full = min(bins, left // each)
            if full:
                put(own + (size,) * each, free - each * size, full)
            left -= full * each
            if full < bins and left and (part := min(left, each)):
                put(own + (size,) * part, free - part * size, 1)
                left -= part
                full += 1
            if full < bins and own:
                put(own, free, bins - full)
    return done + [g for f in rooms for g in groups[f]]


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Recipes (lengths in one sequence, number of such sequences) that use up the histogram."""
    rest = hist.astype(np.int64).copy()
    pats = patterns(rest)
    out = []
    for x, p in sorted(zip(fit(rest, pats), pats, strict=True), reverse=True):
        n = min([int(x), *(int(rest[s]) // p.count(s) for s in set(p))])
        if n:
            out.append((p, n))
            for s in p:
                rest[s] -= n
    return out + best_fit(rest)


def intervals(recipes: list[tuple[tuple[int, ...], int]], cap: int) -> np.ndarray:
    """Rows (length, first rank, first sequence_id, offset), sorted."""
    used, base, rows = [0] * (cap + 1), 0, []
    for own, n in recipes:
        at = 0
        for size in own:
            rows.append((size, used[size], base, at))
            used[size] += n
            at += size
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(rows: np.ndarray, cap: int):
    first = np.searchsorted(rows[:, 0], np.arange(cap + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                lo, hi = first[s], first[s + 1]
                at[own] = lo + np.searchsorted(rows[lo:hi, 1], rank[own], "right") - 1
            seq = rows[at, 2] + rank - rows[at, 1]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(rows[at, 3])], [n for n in batch.schema.names if n != "rank"] + ["sequence_id", "offset"])

    return run


def ranked(df: DataFrame, key: str, order: list[str], rank: str, rows: int) -> DataFrame:
    """Adds a gapless rank from 0 within each key. Groups of (key, salt) are
    ranked apart and shifted by the counts of the salts before them."""
    salts = max(64, rows // 20_000)
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    n = d.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(key, "_salt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    out = d.withColumn("_own", own).join(before, [key, "_salt"])
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(rank))


def packed(docs: DataFrame, tokenizer: str, cap: int = CAP, end: int = 0, with_ids: bool = False) -> DataFrame:
    """token_pieces with sequence_id and offset, the piece's place in its sequence."""
    cut = saved(token_pieces(docs, tokenizer, cap, end, with_ids), "pieces")
    hist = np.zeros(cap + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    rows = intervals(plan(hist), cap)
    order = ranked(cut, "length", ["doc_id", "piece"], "rank", int(hist.sum()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return order.mapInArrow(_place(rows, cap), fields + ", sequence_id long, offset long")
