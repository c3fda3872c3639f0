"""Context-tree weighting over bytes, and a unigram base score.

Model. A text is its bytes with A-Z lower-cased and one end byte 0, after
``DEPTH`` zero bytes of context. A byte is eight binary decisions, each with a
context tree of its own over the 0 to DEPTH preceding bytes. A node predicts by the
Krichevsky-Trofimov estimate of its counts; trees are weighted bottom-up,

    Pw(node) = Pe(node) / 2 + (product of Pw over its children) / 2

and predictions mix the estimates of all depths on the path by the weights' posteriors.
Learning is a count of (DEPTH + 1)-byte runs over all training texts;
everything else follows from the counts, so the order of texts does not matter.

Nodes. Every context met at least ``LEAST`` times is a node of its own, at any corpus
size; the contexts met less often under a node are one child, with the residual
counts. Where a decision was never met at a node, the prediction of the deepest node on
the path that met it holds, and one half where none did. Bit probabilities are
rounded to 16 bits, so the code stays exact.

Place. The model is a table in the shared folder, dealt into shards by the hash of the
``SPLIT`` bytes nearest to the predicted one, so that a shard has whole subtrees; a large shard is
built some subtrees at a time. Only the
depths below ``SPLIT`` are built on the driver and broadcast (at most 2^24 runs). Texts are
packed into pieces of about ``PIECE`` bytes; each asks the shards for its distinct runs,
and their costs come back to it. Runs travel as sorted arrays, packed by differences, not as rows,
and texts compressed, in rows of about ``CHUNK`` bytes, so that no group is held by Spark at once.

Base. Sum over tokens of log10((c + 1) / (N + V + 1)). Counts of frequent words
(at least one in ``nodes`` of all tokens, thus at most ``nodes`` words) are
broadcast; the rest of each text's words is joined to the counts by shuffle.

Defined results: null and empty texts are the end alone; without training texts the
model says one half for each bit and N = V = 0; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import LOWER, SPACE, lean, mix, pieces, saved, text_bytes, word_hashes, word_spans
from ringloom.llm.language_id import Vocabulary

DEPTH, NODES, LEAST = 6, 1 << 18, 2
SPLIT, SHARDS = 3, 32
#: Bytes of text in a row, that ask together, and of training text that a shard stands for.
CHUNK, PIECE, SHARD = 1 << 20, 1 << 23, 1 << 22
END = np.uint64(0x5E0F7E87)  # the end token's place among word hashes
KEEP = 1 << 20  # rows of counts that a task holds before it passes them on
HELD = 1 << 21  # the same of runs
PART = 1 << 18  # runs of a shard that are built at once, but for those of one context of SPLIT bytes
_EIGHT = np.uint64(8)


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << (8 * (d + 1))) - 1)


def framed(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Run keys of every byte and end of all rows, and each row's first one. A key
    holds depth bytes of context and the byte itself, the latest lowest."""
    n = np.diff(off)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    size = int(begin[-1]) + depth * len(n)
    buf = np.zeros(size, np.uint8)
    shift = depth * (np.arange(len(n)) + 1) + np.arange(len(n))
    buf[np.arange(len(data)) + np.repeat(shift, n)] = data
    key = np.zeros(max(0, size - depth), np.uint64)
    for i in range(depth + 1):
        key = key << _EIGHT | buf[i : size - depth + i]
    at = np.arange(begin[-1]) + np.repeat(depth * np.arange(len(n)), n + 1)
    return key[at], begin


def _text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(col)
    return LOWER[data], off


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]])
    n = np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[lead], np.add.reduceat(n, lead) if len(lead) else n


def _dealt(keys: np.ndarray, depth: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of sorted keys by shard, the shards met, and where each begins and the last ends."""
    near = keys >> _EIGHT & np.uint64((1 << (8 * min(SPLIT, depth))) - 1)
    shard = (mix(near) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    met, first = np.unique(shard[order], return_index=True)
    return order, met, np.append(first, len(keys))


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed bytes, place by place: what they share costs little. rising: sorted
    ones, kept as differences."""
    if rising and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True) + len(x).to_bytes(4, "little")


def _unpack(blob: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(blob[-4:], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(blob[:-4], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum(x, dtype=kind) if rising else x


def _blobs(x: np.ndarray, at: np.ndarray, rising: bool = False) -> pa.Array:
    return pa.array([_pack(x[a:b], rising) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def _count(depth: int, shards: int):
    """Runs of the training texts and how often each is met, by shard."""

    def rows(parts: list) -> pa.RecordBatch:
        key, n = _merged(parts)
        order, met, at = _dealt(key, depth, shards)
        return pa.RecordBatch.from_arrays([pa.array(met), _blobs(key[order], at, True), _blobs(n[order], at)], ["shard", "keys", "n"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for lo, hi in pieces(batch.column("text")):
                held.append(np.unique(framed(*_text(batch.column("text").slice(lo, hi - lo)), depth)[0], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(parts: list) -> Iterator[pa.RecordBatch]:
        key, n = _merged(parts)
        for a in range(0, len(key), 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 19)].view(np.int64)), pa.array(n[a : a + (1 << 19)])], ["key", "n"])

    held: list = []
    for batch in batches:
        for lo, hi in pieces(batch.column("text")):
            data, off = _text(batch.column("text").slice(lo, hi - lo))
            starts, ends, _ = word_spans(data, off, SPACE)
            held.append(np.unique(np.concatenate([word_hashes(data, starts, ends), np.full(len(off) - 1, END)]), return_counts=True))
            if sum(len(k) for k, _ in held) > KEEP:
                held = [_merged(held)]
                if len(held[0][0]) > KEEP // 2:
                    yield from rows(held)
                    held = []
    yield from rows(held)


# --- the tree ----------------------------------------------------------------


_SMALL = {shift: np.array([math.lgamma(i + shift) for i in range(256)]) for shift in (0.5, 1.0)}


def _lgamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift): a table for small n, Stirling's series beyond it."""
    x = n + shift
    small = _SMALL[shift]
    big = np.maximum(x, 200.0)
    series = (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(n < 256, small[np.minimum(n, 255).astype(np.int64)], series)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma_half(a, 0.5) + _lgamma_half(b, 0.5) - _lgamma_half(a + b, 1.0) - math.log(math.pi)


def _round(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(p * 65536), 1, 65535).astype(np.uint16)


def _weighed(levels: list[tuple[np.ndarray, np.ndarray]], j: int, first: int = 0, below: tuple | None = None) -> list[dict]:
    """The nodes of bit j, weighted bottom-up. levels[0] is of depth ``first``; below: sorted
    nodes under the last level's and the sums of their children's zeros, ones and weights."""
    last, nodes = len(levels) - 1, []
    for key, n in levels:
        prefix = key >> np.uint64(8 - j)
        fresh = np.ones(len(prefix), bool)
        fresh[1:] = prefix[1:] != prefix[:-1]
        lead, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        bit = (key >> np.uint64(7 - j) & np.uint64(1)).astype(float)
        ones = np.bincount(run, n * bit)
        nodes.append({"prefix": prefix[lead], "run": run, "one": ones, "zero": np.bincount(run, n) - ones})
    for d in range(last, -1, -1):
        x = nodes[d]
        x["pe"] = _kt(x["zero"], x["one"])
        if d == last and below is None or d < last and not len(levels[d + 1][0]):
            x["pw"], x["beta"], x["rest"] = x["pe"], np.ones(len(x["pe"])), (x["zero"], x["one"])
            continue
        if d == last:
            up, parts = np.searchsorted(x["prefix"], below[0]), below[1:]
        else:
            child = nodes[d + 1]
            child["up"] = up = np.searchsorted(x["prefix"], child["prefix"] & (_mask(first + d) >> np.uint64(8 - j)))
            parts = child["zero"], child["one"], child["pw"]
        zero, one, weight = (np.bincount(up, v, minlength=len(x["pe"])) for v in parts)
        x["rest"] = x["zero"] - zero, x["one"] - one
        under = weight + np.where(x["rest"][0] + x["rest"][1] > 0, _kt(*x["rest"]), 0.0)
        x["pw"] = np.logaddexp(x["pe"], under) - math.log(2)
        x["beta"] = np.exp(x["pe"] - math.log(2) - x["pw"])
    return nodes


def build(levels: list[tuple[np.ndarray, np.ndarray]], first: int = 0, above: list | None = None, below: list | None = None, ends: list | None = None) -> list[dict]:
    """Bit probabilities of all (context, byte) entries. levels[d]: sorted keys of depth
    first + d and their counts, of the contexts kept at that depth. above and below: by bit,
    the nodes over the first level's and the children of the last one's, where other
    shards have them; ends receives the last level's nodes, as above takes them."""
    last = len(levels) - 1
    final = [np.zeros((len(k), 8), np.uint16) for k, _ in levels]
    stop = [np.zeros((len(k), 8), np.uint16) for k, _ in levels]
    for j in range(8):
        nodes = _weighed(levels, j, first, below and below[j])
        for d in range(last + 1):
            x = nodes[d]
            if not len(x["pe"]):
                break
            if d:
                acc, left = nodes[d - 1]["acc"][x["up"]], nodes[d - 1]["left"][x["up"]]
            elif above:
                up = np.searchsorted(above[j][0], x["prefix"] & (_mask(first - 1) >> np.uint64(8 - j)))
                acc, left = above[j][1][up], above[j][2][up]
            else:
                acc, left = np.zeros(len(x["pe"])), np.ones(len(x["pe"]))
            p = (x["one"] + 0.5) / (x["one"] + x["zero"] + 1)
            r0, r1 = x["rest"]
            other = np.where(r0 + r1 > 0, (r1 + 0.5) / (r0 + r1 + 1), p)
            stop[d][:, j] = _round(acc + left * p)[x["run"]]
            final[d][:, j] = _round(acc + left * (x["beta"] * p + (1 - x["beta"]) * other))[x["run"]]
            x["acc"], x["left"] = acc + left * x["beta"] * p, left * (1 - x["beta"])
        if ends is not None:
            ends.append((nodes[last]["prefix"], nodes[last].get("acc"), nodes[last].get("left")))
    return [{"keys": k, "final": f, "stop": s} for (k, _), f, s in zip(levels, final, stop, strict=True)]


class Tree:
    """Log10 probabilities of run keys under a built model."""

    def __init__(self, model: list[dict]):
        self.levels = [x for x in model if len(x["keys"])]
        for x in self.levels:
            if "grams" in x:  # of a tree made before
                continue
            x["cost"] = np.concatenate([self._bits(x["final"][a : a + 32768], x["keys"][a : a + 32768].astype(np.uint8)).sum(axis=1) for a in range(0, len(x["keys"]), 32768)])
            x["grams"] = Vocabulary(x["keys"] + np.uint64(1))
            x["contexts"] = Vocabulary(np.unique(x["keys"] >> _EIGHT) + np.uint64(1))

    @staticmethod
    def _bits(q: np.ndarray, byte: np.ndarray) -> np.ndarray:
        one = (byte[:, None] >> np.arange(7, -1, -1, dtype=np.uint8) & 1).astype(bool)
        return np.log10(np.where(one, q, 65536 - q.astype(np.int64)) / 65536)

    def _rare(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Bytes not met in their deepest context: bit by bit down the path."""
        out, done = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        todo, byte, kind = np.arange(len(keys)), keys.astype(np.uint8), "final"
        for d in range(depth, -1, -1):
            if not len(todo):
                break
            x = self.levels[d]
            own = keys[todo] & _mask(d)
            at = np.searchsorted(x["keys"], own)
            share = np.full(len(todo), -1)
            best = np.zeros(len(todo), np.int64)
            for near in (at - 1, np.minimum(at, len(x["keys"]) - 1)):
                k = x["keys"][np.maximum(near, 0)]
                same = (near >= 0) & (k >> _EIGHT == own >> _EIGHT)
                diff = (k ^ own).astype(np.uint8)
                common = np.where(same, np.where(diff == 0, 8, 7 - np.floor(np.log2(np.maximum(diff, 1))).astype(np.int64)), -1)
                best = np.where(common > share, np.maximum(near, 0), best)
                share = np.maximum(share, common)
            j = np.arange(8)
            use = (j >= done[todo, None]) & (j <= share[:, None])
            out[todo] += np.where(use, self._bits(x[kind][best], byte[todo]), 0).sum(axis=1)
            done[todo] = np.maximum(done[todo], np.minimum(share + 1, 8))
            todo, kind = todo[done[todo] < 8], "stop"
        return out + (8 - done) * math.log10(0.5)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        if not self.levels:
            return np.full(len(keys), 8 * math.log10(0.5))
        out = np.empty(len(keys))
        todo = np.arange(len(keys))
        for d in range(len(self.levels) - 1, -1, -1):
            x = self.levels[d]
            own = keys[todo] & _mask(d)
            at = x["grams"].find(own + np.uint64(1))
            hit = at >= 0
            out[todo[hit]] = x["cost"][at[hit]]
            todo, own = todo[~hit], own[~hit]
            kept = x["contexts"].find((own >> _EIGHT) + np.uint64(1)) >= 0 if d else np.ones(len(todo), bool)
            if kept.any():
                out[todo[kept]] = self._rare(keys[todo[kept]], d)
            todo = todo[~kept]
        return out


# --- Spark -------------------------------------------------------------------


def _kept(key: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts at the depths first to last, of the contexts met LEAST times."""
    out = []
    for d in range(last, first - 1, -1):
        key, n = own, c = _merged([(key & _mask(d), n)])
        if d and len(own):
            _, run = np.unique(own >> _EIGHT, return_inverse=True)
            ok = (np.bincount(run, c) >= LEAST)[run]
            own, c = own[ok], c[ok]
        out.append((own, c.astype(float)))
    return out[::-1]


def _parts(key: np.ndarray, n: np.ndarray, depth: int, shards: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A shard's runs and counts in whole subtrees, about PART runs at a time."""
    parts = -(-len(key) // PART)
    if parts < 2:
        yield key, n
        return
    own = mix(key >> _EIGHT & np.uint64((1 << (8 * min(SPLIT, depth))) - 1)) // np.uint64(shards) % np.uint64(parts)
    for i in range(parts):
        yield key[own == i], n[own == i]


def _built(key: np.ndarray, n: np.ndarray, depth: int, shards: int, ends: list) -> list[dict]:
    """The model of a shard's depths."""
    split = min(SPLIT, depth)
    made = [build(_kept(k, c, split, depth), split, ends) for k, c in _parts(key, n, depth, shards)]
    out = []
    for level in zip(*made, strict=True):
        x = {c: np.concatenate([y[c] for y in level]) for c in ("keys", "final", "stop")}
        order = np.argsort(x["keys"], kind="stable")
        out.append({c: v[order] for c, v in x.items()} if len(level) > 1 else x)
    return out


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """(shard, its rows) of rows sorted by shard."""
    return groupby((r for batch in batches for part in range(batch.num_rows) for r in batch.slice(part, 1).to_pylist()), lambda r: r["shard"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, with the merged counts of its runs."""
    for shard, rows in _by_shard(batches):
        held, size, done = [], 0, 0
        for r in rows:
            held.append((_unpack(r["keys"], np.uint64, True), _unpack(r["n"], np.int64)))
            size += len(held[-1][0])
            if size > max(KEEP, 2 * done):
                held = [_merged(held)]
                size = done = len(held[0][0])
        key, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack(key, True)], pa.binary()), pa.array([_pack(n)], pa.binary())], ["shard", "keys", "n"])


def _roots(depth: int, shards: int):
    """What the depths above the shards need of them: counts of runs (j = -1), and by bit the
    zeros, ones and weights of the shards' highest nodes, summed by their parents."""
    split = min(SPLIT, depth)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for key, n in _parts(_unpack(r["keys"], np.uint64, True), _unpack(r["n"], np.int64), depth, shards):
                    own, c = _merged([(key & _mask(split - 1), n)])
                    parts = [(np.full(len(own), -1), own, c.astype(float), np.zeros(len(own)), np.zeros(len(own)))]
                    levels = _kept(key, n, split, depth)
                    for j in range(8):
                        x = _weighed(levels, j, split)[0]
                        up, at = np.unique(x["prefix"] & (_mask(split - 1) >> np.uint64(8 - j)), return_inverse=True)
                        parts.append((np.full(len(up), j), up, *(np.bincount(at, x[v], minlength=len(up)) for v in ("zero", "one", "pw"))))
                    j, prefix, zero, one, pw = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int8)), pa.array(prefix.view(np.int64)), pa.array(zero), pa.array(one), pa.array(pw)], ["j", "prefix", "zero", "one", "pw"])

    return run


def _top(table: DataFrame, depth: int, shards: int) -> tuple[list[dict], list]:
    """The model of the depths above the shards, and its lowest nodes by bit."""
    roots = table.mapInArrow(_roots(depth, shards), "j byte, prefix long, zero double, one double, pw double")
    exact = F.sum(F.col("pw").cast("decimal(28,9)")).cast("double")  # alike in any order
    got = saved(roots.groupBy("j", "prefix").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), exact.alias("pw")), "roots").toArrow()
    j, key = got.column("j").to_numpy(), got.column("prefix").to_numpy().view(np.uint64)
    zero, one, pw = (got.column(c).to_numpy() for c in ("zero", "one", "pw"))
    order = np.lexsort((key, j))
    part = lambda i: order[np.searchsorted(j[order], i) : np.searchsorted(j[order], i, "right")]
    below, ends = [(key[p], zero[p], one[p], pw[p]) for p in map(part, range(8))], []
    own = part(-1)
    split = min(SPLIT, depth)
    return build(_kept(key[own], zero[own].astype(np.int64), 0, split - 1), 0, None, below, ends), ends


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased texts in compressed rows of about CHUNK bytes; about PIECE bytes of a task make a piece."""
    piece, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for lo, hi in pieces(batch.column("text"), CHUNK):
            data, off = _text(batch.column("text").slice(lo, hi - lo))
            n = len(data) + hi - lo
            if size and size + n > PIECE:
                piece, size = piece + 1, 0
            size += n
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo))
            blob = pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), ids, pa.array([off.tobytes()], pa.binary()), pa.array([blob], pa.binary()), pa.array([n], pa.int64())], ["piece", "ids", "off", "texts", "size"])


def _chunk(off: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a row of _packed."""
    off = np.frombuffer(off, np.int64)
    data = pa.decompress(texts, decompressed_size=int(off[-1]), codec="zstd", asbytes=True) if off[-1] else b""
    return np.frombuffer(data, np.uint8), off


def _sorted(x: np.ndarray) -> np.ndarray:
    """Distinct values; sorting takes far less time than np.unique's table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _distinct(chunks: list[tuple[bytes, bytes]], depth: int) -> np.ndarray:
    """Sorted distinct runs of the rows (off, texts) of a piece."""
    held: list = [np.zeros(0, np.uint64)]
    for x in chunks:
        held.append(_sorted(framed(*_chunk(*x), depth)[0]))
        if len(held) > 3:  # what rows share is kept once
            held = [_sorted(np.concatenate(held))]
    return _sorted(np.concatenate(held))


def _by_piece(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """(piece, the named values of its rows) of rows that stand together by piece."""
    rows = ((batch.column("piece")[i].as_py(), tuple(batch.column(c)[i].as_py() for c in names)) for batch in batches for i in range(batch.num_rows))
    for piece, own in groupby(rows, lambda r: r[0]):
        yield piece, [x for _, x in own]


def _ask(depth: int, shards: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, chunks in _by_piece(batches, "off", "texts"):
            key = _distinct(chunks, depth)
            order, met, at = _dealt(key, depth, shards)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.full(len(met), piece)), _blobs(key[order], at, True), pa.nulls(len(met), pa.binary())], ["shard", "piece", "keys", "n"])

    return run


def _answer(depth: int, shards: int, top: list[dict], ends: list):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = Tree(top).levels
        for shard, rows in _by_shard(batches):
            tree, held, size = None, [], 0

            def answers() -> pa.RecordBatch:
                key = np.concatenate([k for _, k in held])  # noqa: B023
                cost = tree.log10(key).astype(np.float32)  # noqa: B023
                at = np.cumsum([0, *(len(k) for _, k in held)])  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int64()), pa.array(np.full(len(held), shard, np.int32)), _blobs(cost, at)], ["piece", "shard", "cost"])  # noqa: B023

            for r in rows:  # the model's row is the first
                key = _unpack(r["keys"], np.uint64, True)
                if r["piece"] < 0:
                    tree = Tree([*above, *_built(key, _unpack(r["n"], np.int64), depth, shards, ends)])
                    continue
                tree = tree or Tree(above)
                held.append((r["piece"], key))
                size += len(key)
                if size > KEEP // 4:
                    yield answers()
                    held, size = [], 0
            if held:
                yield answers()

    return run


def _apply(words: tuple[np.ndarray, np.ndarray], depth: int, shards: int):
    """Scores of rows sorted by piece, its texts and the shards' answers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = Vocabulary(words[0] + np.uint64(1)), np.append(np.log10(words[1] + 1.0), 0.0)  # the last entry stands for words not among them
        for _, rows in _by_piece(batches, "shard", "cost", "ids", "off", "texts"):
            answers = {shard: cost for shard, cost, *_ in rows if cost is not None}
            chunks = [x for _, cost, *x in rows if cost is None]
            del rows
            keys = _distinct([(off, texts) for _, off, texts in chunks], depth)
            order, met, _ = _dealt(keys, depth, shards)
            costs = np.empty(len(keys))
            costs[order] = np.concatenate([np.zeros(0, np.float32), *[_unpack(answers.pop(s), np.float32) for s in met.tolist()]])
            # a table of many runs would take more memory than the time it saves is worth
            find = Vocabulary(keys + np.uint64(1)).find if len(keys) < HELD else lambda k: np.searchsorted(keys, k - np.uint64(1))  # noqa: B023
            for ids, *x in chunks:
                data, off = _chunk(*x)
                key, begin = framed(data, off, depth)
                score = np.add.reduceat(costs[find(key + np.uint64(1))], begin[:-1])
                starts, ends, first = word_spans(data, off, SPACE)
                at = first[1:] + np.arange(len(first) - 1)
                h = np.insert(word_hashes(data, starts, ends), first[1:], END)
                first = np.concatenate([[0], at + 1])
                col = known.find(h + np.uint64(1))
                hit = col >= 0
                base = np.add.reduceat(logs[col], first[:-1])
                met = np.add.reduceat(hit.astype(np.int64), first[:-1])
                rest = np.concatenate([[0], np.cumsum(~hit)])[first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(np.diff(off)), pa.array(np.diff(first)), pa.array(met), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(h[~hit].view(np.int64))),
                ], ["doc_id", "n_bytes", "n_tokens", "met", "base", "score", "rest"])

    return run


def lm_scores(docs: DataFrame, training: Column, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, n_known, train_tokens,
    base_score, score and bits_per_byte, the code length over the bytes and the end.
    training: which documents to learn from."""
    docs = docs.withColumn("_own", training).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_own")
    train = docs.where("_own").select("text")
    staged = saved(docs.select("doc_id", "text").mapInArrow(_packed, "piece long, ids array<long>, off binary, texts binary, size long"), "pieces")
    # shards grow with the texts, so that each stands for about as many bytes
    shards = SHARDS
    while shards * SHARD < (staged.agg(F.sum("size")).first()[0] or 0):
        shards *= 2
    runs = train.mapInArrow(_count(depth, shards), "shard int, keys binary, n binary")
    table = saved(runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(_gather, "shard int, keys binary, n binary"), "model")
    top, ends = _top(table, depth, shards)
    words = saved(train.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-tokens // nodes))
    got = words.where(F.col("n") >= least).toArrow()
    often = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    asked = staged.select("piece", "off", "texts").mapInArrow(_ask(depth, shards), "shard int, piece long, keys binary, n binary")
    asked = table.select("shard", F.lit(-1).cast("long").alias("piece"), "keys", "n").union(asked)
    costs = asked.repartition("shard").sortWithinPartitions("shard", "piece").mapInArrow(_answer(depth, shards, top, ends), "piece long, shard int, cost binary")
    texts = staged.select("piece", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("cost"), "ids", "off", "texts")
    first = texts.unionByName(costs, allowMissingColumns=True).repartition("piece").sortWithinPartitions("piece", "shard")
    first = first.mapInArrow(_apply(often, depth, shards), "doc_id long, n_bytes long, n_tokens long, met long, base double, score double, rest array<long>")
    first = saved(first, "first").withColumn("rid", F.monotonically_increasing_id())
    rest = first.select("rid", F.explode("rest").alias("key")).join(words.where(F.col("n") < least), "key")
    rest = rest.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("part"))
    out = first.drop("rest").join(rest, "rid", "left")
    unit = math.log10(tokens + distinct + 1)
    return out.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("met") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
