"""Sequence kernels behind Arrow batches: pattern and anchor alignment, tandem
scan, partial-order consensus and a small minimizer mapper.

They are plain functions of sequences; the DataFrame functions at the end apply
them to columns. Reads are aligned in batches, all reads a cell at a time.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions.sequence import IUPAC

PATTERN = "CTCNNNYRNNNYRNNNYRNNNGAG"
#: Scores of a pattern base that stands for 1 to 4 bases.
MATCH, MISMATCH, OPEN, EXTEND = (6, 5, 4, 3), (-14, -16, -18, -18), -10, -4
_COMP = str.maketrans("ACGTN", "TGCAN")
_CODES = np.array([IUPAC.get(chr(c), 0) for c in range(256)], np.int8)


def revcomp(s: str) -> str:
    return s.translate(_COMP)[::-1]


def _masks(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in seqs], np.int64)
    out = np.zeros((len(seqs), int(size.max(initial=0))), np.int8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = _CODES[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    return out, size


def _by_length(f, seqs: list[str], cells: int = 1 << 21) -> list:
    """f of the sequences, in groups of similar lengths that fill at most ``cells`` places when padded, so
    that one long read neither pads the others nor the memory."""
    order, out, lo = sorted(range(len(seqs)), key=lambda i: len(seqs[i])), [None] * len(seqs), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(seqs[order[hi]]) <= cells:
            hi += 1
        for i, r in zip(order[lo:hi], f([seqs[i] for i in order[lo:hi]]), strict=True):
            out[i] = r
        lo = hi
    return out


def match_pattern(seqs: list[str], pattern: str = PATTERN) -> list[tuple[int, int, int]]:
    """(score, start, end) of the best match in each sequence that ends with the
    pattern's end; it may start anywhere in both. A gap that follows a gap of its
    kind extends it; of equal moves up (sequence), left (pattern), diagonal the first wins."""
    q, size = _masks(seqs)
    q = np.ascontiguousarray(q.T)
    p = [IUPAC[c] for c in pattern]
    kinds = [bin(m).count("1") - 1 for m in p]
    n, b, m = len(q), len(seqs), len(p)
    # a cell of all sequences at a time: rows of cells lie together
    h, move, begin = np.zeros((m + 1, b), np.int32), np.zeros((m + 1, b), np.int8), np.zeros((m + 1, b), np.int32)
    best = np.full(b, -(10**9), np.int32)
    at = np.zeros((b, 2), np.int64)
    for i in range(1, n + 1):
        nh, nm, ns = np.zeros_like(h), np.zeros_like(move), np.full_like(begin, i)
        up = h + np.where(move == 1, np.int32(EXTEND), np.int32(OPEN))
        sub = {x: np.where(q[i - 1] & x, np.int32(MATCH[k]), np.int32(MISMATCH[k])) for x, k in zip(p, kinds, strict=True)}
        for j in range(1, m + 1):
            left = nh[j - 1] + np.where(nm[j - 1] == 2, np.int32(EXTEND), np.int32(OPEN))
            top = np.maximum(np.maximum(up[j], left), h[j - 1] + sub[p[j - 1]])
            k = np.where(top == up[j], np.int8(1), np.where(top == left, np.int8(2), np.int8(3)))
            nh[j], nm[j] = top, k
            ns[j] = np.where(k == 1, begin[j], np.where(k == 2, ns[j - 1], begin[j - 1]))
        h, move, begin = nh, nm, ns
        better = (h[m] > best) & (i <= size)
        best = np.where(better, h[m], best)
        at[better, 0], at[better, 1] = begin[m][better], i
    return [(int(s), int(x), int(y)) for s, (x, y) in zip(best, at, strict=True)]


def local_anchor(seqs: list[str], anchor: str, match: int = 3, mismatch: int = -6, first: int = -7, more: int = -2) -> list[tuple[int, int]]:
    """(score, end) of each sequence's best local alignment with the anchor; a gap
    of n costs first + (n - 1) * more."""
    q, size = _masks(seqs)
    q = np.ascontiguousarray(q.T)
    a = [IUPAC[c] for c in anchor]
    b, m, low = len(seqs), len(a), -(10**9)
    h, e = np.zeros((m + 1, b), np.int32), np.full((m + 1, b), low, np.int32)
    best, end = np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(len(q)):
        nh, f = np.zeros_like(h), np.full(b, low, np.int32)
        e = np.maximum(h + first, e + more)
        sub = {x: np.where(q[i] == x, np.int32(match), np.int32(mismatch)) for x in set(a)}
        floor = np.maximum(e, 0)
        for j in range(1, m + 1):
            f = np.maximum(nh[j - 1] + first, f + more)
            d = h[j - 1] + sub[a[j - 1]]
            nh[j] = np.maximum(np.maximum(d, f), floor[j])
        h = nh
        top = h.max(axis=0)
        better = (top > best) & (i < size)
        best, end = np.where(better, top, best), np.where(better, i + 1, end)
    return list(zip(best.tolist(), end.tolist(), strict=True))


def extract_umis(ids: list[str], seqs: list[str], anchor: str, pattern: str = PATTERN, least: int = 200) -> list[tuple]:
    """(id, strand, umi, read without the UMI) of reads in which the UMI is found.
    Strand + where the anchor fits the read better than its reverse complement;
    the UMI is looked for from 5 before the anchor's end to 5 beyond its length."""
    own = [(i, s) for i, s in zip(ids, seqs, strict=True) if s and len(s) >= least]
    if not own:
        return []
    both = [s for _, s in own], [revcomp(s) for _, s in own]
    fwd, rev = (_by_length(lambda part: local_anchor(part, anchor), x) for x in both)
    plus = [f[0] > r[0] for f, r in zip(fwd, rev, strict=True)]
    read = [both[0][i] if p else both[1][i] for i, p in enumerate(plus)]
    ends = [(fwd if p else rev)[i][1] for i, p in enumerate(plus)]
    lo = [max(0, e - 5) for e in ends]
    part = [r[a : e + len(pattern) + 5] for r, a, e in zip(read, lo, ends, strict=True)]
    out = []
    for (i, _), p, r, a, w, (_, s, e) in zip(own, plus, read, lo, part, match_pattern(part, pattern), strict=True):
        if round(0.8 * len(pattern)) <= e - s <= round(1.2 * len(pattern)):
            rest = r[a + e + 1 :]  # one base behind the UMI goes with it
            out.append((i, "+" if p else "-", w[s:e], revcomp(rest)))
    return out


# --- consensus -----------------------------------------------------------------


class Graph:
    """A partial-order graph: nodes with a base, a ring of aligned nodes, weighted edges."""

    def __init__(self):
        self.base: list[str] = []
        self.ring: list[list[int]] = []
        self.pred: list[dict[int, int]] = []
        self.succ: list[dict[int, int]] = []

    def node(self, c: str) -> int:
        self.base.append(c)
        self.ring.append([])
        self.pred.append({})
        self.succ.append({})
        return len(self.base) - 1

    def order(self) -> list[int]:
        left = [len(p) for p in self.pred]
        ready = [i for i, n in enumerate(left) if not n]
        out = []
        while ready:
            i = ready.pop()
            out.append(i)
            for j in self.succ[i]:
                left[j] -= 1
                if not left[j]:
                    ready.append(j)
        return out

    def align(self, s: str) -> list[tuple[int, int]]:
        """(node, position) pairs of the best alignment, -1 for a gap: the graph's ends are
        free, gaps are convex: the better of -8, -2 more and -24, -1 more; match 10, mismatch -4."""
        return align_all([self], [s])[0]

    def trace(self, s: str, order: list[int], h: np.ndarray, f: np.ndarray, o: np.ndarray) -> list[tuple[int, int]]:
        """The pairs of align() from its filled tables, a row per node in this order behind row 0."""
        row = {v: k + 1 for k, v in enumerate(order)}
        sinks = np.array([row[v] for v in order if not self.succ[v]])
        ends = h[sinks].argmax(axis=1)
        at = int(h[sinks, ends].argmax())  # rows rise: the first of equal ones
        i, j = int(sinks[at]), int(ends[at])
        back, pairs = {k: v for v, k in row.items()}, []
        while i and j:
            v = back[i]
            ups = [row[u] for u in self.pred[v]] or [0]
            hit = 10 if s[j - 1] == self.base[v] else -4
            u = next((u for u in ups if h[u, j - 1] + hit == h[i, j]), None)
            if u is not None:
                pairs.append((v, j - 1))
                i, j = u, j - 1
                continue
            cost = lambda k: max(-8 - 2 * (k - 1), -24 - (k - 1))
            k = next((k for k in range(1, j + 1) if h[i, j - k] + cost(k) == h[i, j]), 0)
            if k:
                pairs += [(-1, x) for x in range(j - 1, j - k - 1, -1)]
                j -= k
                continue
            table, price = (f, (8, 2)) if f[i, j] == h[i, j] else (o, (24, 1))
            while True:  # a gap along the graph, back to where it opened
                pairs.append((v, -1))
                ups = [row[u] for u in self.pred[v]] or [0]
                opened = next((u for u in ups if h[u, j] - price[0] == table[i, j]), None)
                if opened is not None:
                    i = opened
                    break
                i = next(u for u in ups if table[u, j] - price[1] == table[i, j])
                v = back[i]
        pairs += [(-1, x) for x in range(j - 1, -1, -1)]
        return pairs[::-1]

    def add(self, s: str, times: int = 1, pairs: list[tuple[int, int]] | None = None) -> None:
        """Adds a sequence, as if it came that many times in a row. pairs: its alignment, if known."""
        pairs = pairs or (self.align(s) if self.base else [(-1, i) for i in range(len(s))])
        used = {x: v for v, x in pairs if x >= 0}
        last = -1
        for x, c in enumerate(s):
            v = used.get(x, -1)
            if v < 0:
                own = self.node(c)
            elif self.base[v] == c:
                own = v
            else:
                own = next((u for u in self.ring[v] if self.base[u] == c), -1)
                if own < 0:
                    own = self.node(c)
                    self.ring[own] = [v, *self.ring[v]]
                    for u in self.ring[own]:
                        self.ring[u] = [*self.ring[u], own]
            if last >= 0:
                w = self.succ[last].get(own, 0) + 2 * times
                self.succ[last][own] = self.pred[own][last] = w
            last = own

    def consensus(self) -> str:
        """The heaviest path: each node keeps its heaviest way in, and the path is
        carried on over the heaviest ways out until a sink."""
        score, way = {}, {}
        for v in self.order():
            best = max(((w, score[u], u) for u, w in self.pred[v].items()), default=None)
            score[v], way[v] = (best[0] + best[1], best[2]) if best else (0, -1)
        v = max(score, key=lambda x: (score[x], -x))
        tail, x = [], v
        while self.succ[x]:
            x = max(self.succ[x].items(), key=lambda t: (t[1], score[t[0]], -t[0]))[0]
            tail.append(x)
        path = []
        while v >= 0:
            path.append(v)
            v = way[v]
        return "".join(self.base[i] for i in path[::-1] + tail)


def align_all(graphs: list[Graph], seqs: list[str]) -> list[list[tuple[int, int]]]:
    """Graph.align of each graph with its sequence. Nodes as far from the start of their
    graph as each other are filled in together, those of all graphs at a time."""
    m = max(map(len, seqs))
    code = np.zeros((len(seqs), m), np.uint8)
    orders, base, total = [], [], 0
    rows, ups, starts, letters, whose = ([] for _ in range(5))  # by level
    for k, (g, s) in enumerate(zip(graphs, seqs, strict=True)):
        code[k, : len(s)] = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
        order, row, level = g.order(), {}, {}
        orders.append(order)
        base.append(total)
        for i, v in enumerate(order, total + 1):
            row[v] = i
            pred = g.pred[v]
            level[v] = at = 1 + max(map(level.__getitem__, pred)) if pred else 0
            if at == len(rows):
                for x in (rows, ups, starts, letters, whose):
                    x.append([])
            rows[at].append(i)
            starts[at].append(len(ups[at]))
            ups[at] += map(row.__getitem__, pred) if pred else (total,)
            letters[at].append(g.base[v])
            whose[at].append(k)
        total += len(order) + 1
    low = -(10**8)
    h, f, o = (np.full((total, m + 1), low, np.int32) for _ in range(3))
    j = np.arange(m + 1, dtype=np.int32)
    h[base] = np.maximum(-8 - 2 * (j - 1), -24 - (j - 1))
    h[base, 0] = 0
    for own, up, start, letter, k in zip(rows, ups, starts, letters, whose, strict=True):
        hu, fu, ou = h[up], f[up], o[up]
        fn, on, diag = np.maximum(hu - 8, fu - 2), np.maximum(hu - 24, ou - 1), hu[:, :-1]
        if len(up) > len(own):
            fn, on, diag = (np.maximum.reduceat(x, start, axis=0) for x in (fn, on, diag))
        is_ = np.frombuffer("".join(letter).encode("latin-1", "replace"), np.uint8)
        best = np.maximum(fn, on)
        best[:, 1:] = np.maximum(best[:, 1:], diag + np.where(code[k] == is_[:, None], np.int32(10), np.int32(-4)))
        best[:, 0] = 0
        # gaps along the sequence: running maxima of both gap lines
        e = np.maximum.accumulate(best + 2 * j, axis=1)[:, :-1] - 2 * j[1:] - 6
        q = np.maximum.accumulate(best + j, axis=1)[:, :-1] - j[1:] - 23
        best[:, 1:] = np.maximum(best[:, 1:], np.maximum(e, q))
        h[own], f[own], o[own] = best, fn, on
    out = []
    for g, s, order, at in zip(graphs, seqs, orders, base, strict=True):
        cut = slice(at, at + len(order) + 1), slice(0, len(s) + 1)
        out.append(g.trace(s, order, h[cut], f[cut], o[cut]))
    return out


def consensus_all(groups: list[tuple[list[str], list[int]]], cells: int = 1 << 22) -> list[str]:
    """Partial-order consensus of each group of sequences, in the given order, with how often each counts: none is '', one
    is itself. The groups grow side by side, as many at a time as fill ``cells`` places of the tables."""
    own = [[(s, n) for s, n in zip(*g, strict=True) if s] for g in groups]
    out = [g[0][0] if g else "" for g in own]
    graphs = {k: Graph() for k, g in enumerate(own) if len({s for s, _ in g}) > 1}
    for k, g in graphs.items():
        g.add(*own[k][0])
    for x in range(1, max((len(own[k]) for k in graphs), default=0)):
        part, rows, wide = [], 0, 0
        todo = [k for k in graphs if x < len(own[k])]
        for k in [*todo, None]:
            n, m = (len(graphs[k].base) + 1, len(own[k][x][0]) + 1) if k is not None else (0, 0)
            if part and (k is None or (rows + n) * max(wide, m) > cells):
                for i, pairs in zip(part, align_all([graphs[i] for i in part], [own[i][x][0] for i in part]), strict=True):
                    graphs[i].add(*own[i][x], pairs)
                part, rows, wide = [], 0, 0
            part, rows, wide = [*part, k], rows + n, max(wide, m)
    for k, g in graphs.items():
        out[k] = g.consensus()
    return out


def consensus(seqs: list[str], times: list[int] | None = None) -> str:
    """Partial-order consensus in the given order; none is '', one is itself. times: how
    often each sequence counts."""
    return consensus_all([(seqs, times or [1] * len(seqs))])[0]


# --- tandem repeats --------------------------------------------------------------


def _edit(a: str, b: str) -> int:
    """Edit distance; a column of its table is the bits of two numbers (rises and falls)."""
    if a == b or not a or not b:
        return 0 if a == b else len(a) + len(b)
    n, at = len(a), defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, out = full, 0, n
    for c in b:
        eq = at.get(c, 0)
        x, y = eq | down, ((eq & up) + up ^ up) | eq
        right, left = (down | ~(y | up)) & full, up & y
        out += (right & top > 0) - (left & top > 0)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(x | right)) & full, right & x
    return out


def density_peak(values: list[int]) -> int:
    """Value of highest Gaussian density in single precision, bandwidth n ** -0.2; the least of equal ones."""
    own, n = np.unique(np.array(values, np.float32), return_counts=True)
    bw = np.float32(len(values) ** -0.2)
    d = (np.exp(np.float32(-0.5) * ((own[:, None] - own[None]) / bw) ** 2) * n).sum(axis=1, dtype=np.float32)
    return int(own[int(d.argmax())])


def silverman(n: int) -> float:
    """Silverman's bandwidth for n values."""
    return (n * 3 / 4) ** -0.2


def merged_peak(values: list[int]) -> int:
    """The most frequent value of the best supported run of values, where runs are chained by gaps of 5 and, once a
    peak is known, by 2.3 * sqrt(peak / 10); it settles where a step moves it by more than 2 or
    changes nothing. Ties go to the least value."""
    n = Counter(values)
    peak, delta, seen = min(n, key=lambda v: (-n[v], v)), 5, set()
    while (peak, delta) not in seen:
        seen.add((peak, delta))
        runs: list[list[int]] = []
        for v in sorted(n):
            if runs and v <= runs[-1][-1] + delta:
                runs[-1].append(v)
            else:
                runs.append([v])
        best = max(runs, key=lambda r: (sum(n[v] for v in r), -r[0]))
        top = min(best, key=lambda v: (-n[v], v))
        if abs(top - peak) > 2:
            break
        peak, delta = top, int(2.3 * math.sqrt(0.1 * max(top, 0)))
    return peak


def _squeeze(s: str) -> tuple[str, list[int]]:
    at = [i for i, c in enumerate(s) if not i or c != s[i - 1]]
    return "".join(s[i] for i in at), at


def tandem_segments(seq: str, k: int, squeezed: bool, nearest: int = 40) -> list[tuple[int, int]]:
    """Segments of a tandem repeat (0-based half-open), none if there is none."""
    s, place = _squeeze(seq) if squeezed else (seq, list(range(len(seq))))
    seen: dict[str, list[int]] = defaultdict(list)
    for i in range(len(s) - k + 1):
        seen[s[i : i + k]].append(place[i])
    gaps = [b - a for p in seen.values() for a, b in zip(p, p[1:], strict=False) if b - a >= nearest]
    if len(gaps) <= 2:
        return []
    d = density_peak(gaps)
    if Counter(gaps)[d] < 2:
        return []
    slack = math.floor(2.3 * math.sqrt(0.1 * d))
    hits = sorted((a, b) for p in seen.values() for x, a in enumerate(p) for b in p[x + 1 :] if abs(b - a - d) <= slack)
    if not hits:
        return []
    chain, last = [hits[0]], hits[0]
    for h in hits[1:]:  # positions rise together
        if h[1] > last[1] and h[0] > last[0]:
            chain.append(h)
            last = h
    to = dict(chain)
    at, cuts = chain[0][0], [chain[0][0]]
    keys = sorted(to)
    while True:
        if at in to:
            at = to[at]
        else:
            near = min(keys, key=lambda x: (abs(x - at), x))
            if abs(near - at) > slack + d // 4:
                break
            at = to[near] + at - near
        if at >= len(seq):
            break
        cuts.append(at)
    end = min(len(seq), max(cuts[-1] + 1, chain[-1][1] + k))
    out = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    if end - cuts[-1] >= 1:
        out.append((cuts[-1], min(end, cuts[-1] + d)))
    if len(out) < 2 or out[0][0] > 100 or out[-1][1] < len(seq) - 100 or len(out) == 2 and out[1][1] - out[1][0] < 30:
        return []
    return out


def tandem_consensus(seq: str) -> tuple[str, str] | None:
    """(segments text, consensus) of a read, by the first of (11, plain), (8,
    plain), (11, squeezed), (8, squeezed) that finds segments; None if none does or they differ too much."""
    return tandem_consensuses([seq])[0]


def tandem_consensuses(seqs: list[str]) -> list[tuple[str, str] | None]:
    """tandem_consensus of each read."""
    kinds = ((11, False), (8, False), (11, True), (8, True))
    found = [next((seg for k, squeezed in kinds if (seg := tandem_segments(s, k, squeezed))), []) if len(s) > 50 else [] for s in seqs]
    parts = [[s[a:b] for a, b in seg] for s, seg in zip(seqs, found, strict=True)]
    out: list[tuple[str, str] | None] = []
    for seg, own, c in zip(found, parts, consensus_all([(p, [1] * len(p)) for p in parts]), strict=True):
        good = bool(seg)
        for i, p in enumerate(own):
            tail = i == len(own) - 1
            ref = c[: len(p)] if tail and len(p) < len(c) else c
            good = good and _edit(p, ref) <= (0.35 if tail else 0.2) * max(len(p), 1)
        out.append((";".join(f"{a}-{b}" for a, b in seg), c) if good else None)
    return out


# --- mapping -------------------------------------------------------------------


def minimizers(seq: str, k: int, w: int) -> list[tuple[int, int, int]]:
    """(hash, position, strand) of the least canonical k-mer of each window of w."""
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    m = (1 << (2 * k)) - 1
    fwd = rev = run = 0
    own = []
    for i, c in enumerate(seq):
        x = code.get(c, -1)
        if x < 0:
            fwd = rev = run = 0
            continue
        fwd, rev, run = (fwd << 2 | x) & m, rev >> 2 | (3 - x) << (2 * (k - 1)), run + 1
        if run >= k and fwd != rev:
            own.append(((min(fwd, rev) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, i - k + 1, int(rev < fwd)))
    return sorted({min(own[i : i + w]) for i in range(max(0, len(own) - w + 1))}, key=lambda x: x[1])


def mapped(query: str, target: str, k: int = 10, w: int = 10, least: int = 40) -> list[tuple[int, int, int, int, str, int]]:
    """Chains of shared minimizers: (query start, end, target start, end, strand,
    score), best first; a chain has three anchors or more and overlaps none better by half of it."""
    own = _anchors(query, target, k, w)
    (score, back), = _chained([own], k)
    return _hits(own, score, back, k, least)


def _anchors(query: str, target: str, k: int, w: int) -> list[tuple[int, int, int]]:
    """(other strand, target position, query position) of shared minimizers, sorted."""
    where = defaultdict(list)
    for h, p, s in minimizers(target, k, w):
        where[h].append((p, s))
    return sorted((s ^ t, p if s == t else -p, q) for h, q, s in minimizers(query, k, w) for p, t in where[h])


def _chained(reads: list[list[tuple[int, int, int]]], k: int, back_to: int = 200, far: int = 5000, cells: int = 1 << 16) -> list[tuple[list[float], list[int]]]:
    """The best chain's score that ends at each anchor, and the anchor before it there (-1: none), for each
    read's anchors. The reads of similar numbers of anchors are dealt with together, an anchor of all at a time."""
    cost = np.array([0.008 * k * g + 0.5 * math.log2(g + 1) if g else 0 for g in range(far + 1)])
    out: list = [([], []) for _ in reads]
    order, lo = sorted((i for i, a in enumerate(reads) if a), key=lambda i: len(reads[i])), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(reads[order[hi]]) <= cells:
            hi += 1
        part, lo = order[lo:hi], hi
        n = len(reads[part[-1]])
        at = np.zeros((len(part), n, 3), np.int64)
        for x, i in enumerate(part):
            at[x, : len(reads[i])] = reads[i]
        st, p, q = (np.ascontiguousarray(at[:, :, c]) for c in range(3))
        score, back, row = np.full((len(part), n), float(k)), np.full((len(part), n), -1), np.arange(len(part))
        for i in range(1, n):
            a = max(0, i - back_to)
            dp, dq = p[:, i, None] - p[:, a:i], q[:, i, None] - q[:, a:i]
            ok = (st[:, i, None] == st[:, a:i]) & (dp > 0) & (dq > 0) & (np.maximum(dp, dq) <= far)
            s = np.where(ok, score[:, a:i] + np.minimum(np.minimum(dp, dq), k) - cost[np.minimum(np.abs(dp - dq), far)], -np.inf)
            j = s.argmax(axis=1)
            top = s[row, j]
            better = top > k
            score[better, i], back[better, i] = top[better], a + j[better]
        for x, i in enumerate(part):
            out[i] = score[x, : len(reads[i])].tolist(), back[x, : len(reads[i])].tolist()
    return out


def _hits(anchors: list[tuple[int, int, int]], score: list[float], back: list[int], k: int, least: int) -> list[tuple[int, int, int, int, str, int]]:
    used, out = set(), []
    for i in sorted(range(len(anchors)), key=lambda x: (-score[x], x)):
        chain, j = [], i
        while j >= 0 and j not in used:
            chain.append(j)
            j = back[j]
        gain = score[i] - (score[j] if j >= 0 else 0)
        used.update(chain)
        if len(chain) < 3 or gain < least:
            continue
        a, b = anchors[chain[-1]], anchors[chain[0]]
        t = (a[1], b[1] + k) if not a[0] else (-b[1], -a[1] + k)
        hit = (a[2], b[2] + k, *t, "-" if a[0] else "+", int(gain))
        if all(min(hit[1], o[1]) - max(hit[0], o[0]) <= 0.5 * (hit[1] - hit[0]) for o in out):
            out.append(hit)
    return out


def spliced_chains(query: str, target: str, k: int = 14, w: int = 5, intron: int = 20, least: int = 40, share: float = 0.8, most: int = 6) -> list[list[tuple[int, int]]]:
    """Exon blocks on the target (0-based half-open) of the best forward chains of shared minimizers, a gap
    of more than ``intron`` target bases without as many query bases being an intron. Chains of less than ``share`` of the best
    score, and all after ``most``, go."""
    where = defaultdict(list)
    for h, p, t in minimizers(target, k, w):
        where[h].append((p, t))
    anchors = sorted((p, q) for h, q, s in minimizers(query, k, w) for p, t in where[h] if s == t)
    if not anchors:
        return []
    at = np.array(anchors, np.int64)
    score, back = np.zeros(len(at)), np.full(len(at), -1)
    for i in range(len(at)):
        lo = max(0, i - 400)
        dp, dq = at[i, 0] - at[lo:i, 0], at[i, 1] - at[lo:i, 1]
        gap = dp - dq
        # reference gaps are introns and cost little; others cost by their length
        cost = np.where(gap > 0, np.minimum(0.01 * k * gap, 0.5 * np.log2(np.abs(gap) + 1.0)), 0.01 * k * -gap + 0.5 * np.log2(np.abs(gap) + 1.0))
        s = np.where((dp > 0) & (dq > 0) & (dq <= 5000), score[lo:i] + np.minimum(np.minimum(dp, dq), k) - cost, -1.0)
        best = int(s.argmax()) if len(s) else -1
        score[i], back[i] = (s[best], lo + best) if best >= 0 and s[best] > k else (k, -1)
        if back[i] < 0:
            score[i] = k
    used, found = np.zeros(len(at), bool), []
    for i in np.argsort(-score, kind="stable"):
        if used[i] or len(found) >= most or score[i] < least or found and score[i] < share * found[0][0]:
            continue
        chain, j = [], int(i)
        while j >= 0 and not used[j]:
            chain.append(j)
            used[j] = True
            j = int(back[j])
        gain = score[i] - (score[j] if j >= 0 else 0)  # what another chain has is not this one's
        if len(chain) >= 3 and gain >= least and (not found or gain >= share * found[0][0]):
            found.append((gain, [anchors[j] for j in chain[::-1]]))
    return [_blocks(query, target, chain, k, intron) for _, chain in found]


def _blocks(query: str, target: str, chain: list[tuple[int, int]], k: int, intron: int) -> list[tuple[int, int]]:
    """A chain's exon blocks; an intron's place between two anchors is where most bases match,
    GT..AG (or CT..AC, from the other strand) before others, the leftmost of equal ones."""
    p, q = chain[0]
    while p and q and target[p - 1] == query[q - 1]:
        p, q = p - 1, q - 1
    out, start = [], p
    for (p0, q0), (p1, q1) in zip(chain, chain[1:], strict=False):
        if (p1 - p0) - (q1 - q0) <= intron:
            continue
        lo, hi = q0, q1 + k  # query bases that may lie on either side
        left = [query[x] == target[p0 + x - q0] for x in range(lo, hi)]
        right = [query[x] == target[p1 + k - (hi - x)] for x in range(lo, hi)]
        best, most = lo, -(10**9)
        hits = sum(right)
        for x in range(lo, hi + 1):
            a, b = p0 + x - q0, p1 + k - (hi - x)
            motif = target[a : a + 2] + target[max(0, b - 2) : b]
            value = 4 * hits + (3 if motif in ("GTAG", "CTAC") else 0)
            if value > most and b > a:
                best, most = x, value
            if x < hi:
                hits += left[x - lo] - right[x - lo]
        out.append((start, p0 + best - q0))
        start = p1 + k - (hi - best)
    p, q = chain[-1][0] + k, chain[-1][1] + k
    while p < len(target) and q < len(query) and target[p] == query[q]:
        p, q = p + 1, q + 1
    out.append((start, p))
    return out


def seam_junctions(exons: list[tuple[int, int]], size: int, hang: int = 300) -> list[tuple[int, int]]:
    """(left, right) offsets of the back-splices that exon blocks on a doubled window show: the window is
    a region of ``size`` with ``hang`` on both sides, put twice in a row. A back-splice leads from the
    block that ends nearest to the region's first end to the next block, if that one begins nearest to
    the region's second start. Offsets count from the region's start: of the circle's first base, and behind its last."""
    begin, end, middle = 3 * hang + size, hang + size, 2 * hang + size
    starts, ends = [abs(a - begin) for a, _ in exons], [abs(b - end) for _, b in exons]
    first = {i - 1 for i, d in enumerate(starts) if d == min(starts)}
    last = {i for i, d in enumerate(ends) if d == min(ends)}
    both = first & last
    if not both and len(first) == len(last) == 1 and first.copy().pop() + 1 in last:
        (i,) = last  # one block is the nearest to both
        if exons[i][0] < middle:
            if i + 1 < len(exons) and exons[i + 1][0] > middle:
                both = {i}
        elif i and exons[i - 1][1] < middle:
            both = {i - 1}
    found = [(exons[i + 1][0] - begin, exons[i][1] - hang) for i in sorted(both) if 0 <= i < len(exons) - 1]
    return [(a, b) for a, b in found if a + 1 <= b]


def back_splices(read: str, window: str, hang: int = 300) -> list[tuple[str, int, int]]:
    """(strand, left, right): back-splices of a read whose longest alignment is the window but for ``hang``
    bases on each side; offsets as in seam_junctions, the strand that of the read."""
    size, out = len(window) - 2 * hang, []
    if size <= 0:
        return out
    for strand, query in (("+", read), ("-", revcomp(read))):
        for exons in spliced_chains(query, window + window):
            out += [(strand, a, b) for a, b in seam_junctions(exons, size, hang)]
    return out


def maps_repeatedly(read: str, ref: str) -> bool:
    """Two hits or more of the read on its own reference, at most half of the gaps
    between them longer than a fifth of the read."""
    return map_repeatedly([read], [ref])[0]


def map_repeatedly(reads: list[str], refs: list[str], k: int = 10, w: int = 10, least: int = 40) -> list[bool]:
    """maps_repeatedly of each read and reference."""
    own, out = [_anchors(r, t, k, w) for r, t in zip(reads, refs, strict=True)], []
    for read, anchors, (score, back) in zip(reads, own, _chained(own, k), strict=True):
        hits = sorted((h[0], h[1]) for h in _hits(anchors, score, back, k, least))
        gaps = [b[0] - a[1] for a, b in zip(hits, hits[1:], strict=False)]
        out.append(len(hits) >= 2 and sum(g > len(read) / 5 for g in gaps) <= len(gaps) / 2)
    return out


# --- DataFrames ----------------------------------------------------------------


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by key over tasks enough for kernels that cost far more than reading: a small table of many
    reads lies in one file and would be one task, and few bytes would be joined to few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def _batched(f, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = f(b)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return run


def umi_reads(reads: DataFrame, anchor: str, pattern: str = PATTERN, least: int = 200) -> DataFrame:
    """read_id, strand, umi, seq. Short reads leave before Python sees them."""
    f = lambda b: extract_umis(b.column("read_id").to_pylist(), b.column("seq").to_pylist(), anchor, pattern, least)
    d = reads.where(F.length("seq") >= least).select("read_id", "seq")
    return spread(d, "read_id").mapInArrow(_batched(f, ["read_id", "strand", "umi", "seq"], [pa.string()] * 4), "read_id string, strand string, umi string, seq string")


def ccs_reads(reads: DataFrame, least: int = 100) -> DataFrame:
    """read_id, segments, ccs, raw of reads that are tandem repeats."""

    def f(b: pa.RecordBatch) -> list[tuple]:
        ids, seqs = b.column("read_id").to_pylist(), b.column("seq").to_pylist()
        return [(i, *c, s) for i, s, c in zip(ids, seqs, tandem_consensuses(seqs), strict=True) if c]

    d = reads.where(F.length("seq") >= least).select("read_id", "seq")
    return spread(d, "read_id").mapInArrow(_batched(f, ["read_id", "segments", "ccs", "raw"], [pa.string()] * 4), "read_id string, segments string, ccs string, raw string")


def consensus_by(segments: DataFrame, key: str, most: int = 200) -> DataFrame:
    """One partial-order consensus per key. segments: key, ord (their order), seq.

    Equal segments of a key are one with a count, which leaves the graph as it is. A key
    of up to ``most`` different ones is one graph; those of a larger key are dealt by hash
    into groups of about ``most``, and the consensus is that of the groups' consensuses, each
    counted as often as its group has segments, so no task holds a whole hot key."""
    kinds = segments.select(F.col(key).cast("string").alias(key), F.col("ord").cast("long").alias("ord"), "seq")
    kinds = kinds.groupBy(key, "seq").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    size = kinds.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_chunks"))
    schema = f"{key} string, ord long, seq string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, list]] = []

        def out() -> pa.RecordBatch:
            made = consensus_all([([s for _, s, _ in g], [n for _, _, n in g]) for _, g in done])
            cols = [k for k, _ in done], [g[0][0] for _, g in done], made, [sum(n for _, _, n in g) for _, g in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [key, "ord", "seq", "n"])

        last, size = None, 0
        for b in batches:
            for k, c, *r in zip(*(b.column(c).to_pylist() for c in (key, "_chunk", "ord", "seq", "n")), strict=True):
                if (k, c) != last:
                    if len(done) >= 64 or size > 1 << 22:
                        yield out()
                        size = 0
                    done.append((k, []))
                    last = k, c
                done[-1][1].append(tuple(r))
                size += len(r[1] or "")
        if done:
            yield out()

    def made(d: DataFrame) -> DataFrame:
        """Whole groups, many of them at a time in a task."""
        d = spread(d, key, "_chunk").sortWithinPartitions(key, "_chunk", "ord", "seq")
        return d.select(key, "_chunk", "ord", "seq", "n").mapInArrow(run, schema)

    dealt = kinds.join(size, key).withColumn("_chunk", F.pmod(F.xxhash64("seq"), F.col("_chunks")))
    return made(made(dealt).withColumn("_chunk", F.lit(0).cast("long"))).select(key, "seq")


def remap_flags(pairs: DataFrame) -> DataFrame:
    """Adds remapped: whether seq maps repeatedly to ref. pairs: query_id, seq, ref."""
    f = lambda b: list(zip(b.column("query_id").to_pylist(), map_repeatedly(b.column("seq").to_pylist(), b.column("ref").to_pylist()), strict=True))
    return spread(pairs.select(F.col("query_id").cast("string"), "seq", "ref"), "query_id").mapInArrow(_batched(f, ["query_id", "remapped"], [pa.string(), pa.bool_()]), "query_id string, remapped boolean")


def junction_hypotheses(rows: DataFrame, hang: int = 300) -> DataFrame:
    """query_id, chr, strand, start_pos, end_pos (1-based) proposed for each read by mapping it over the seam
    of its longest alignment. rows: query_id, chr, ref_start (0-based), seq (the read), window (the
    alignment's region with ``hang`` bases on both sides; rows without all of them propose nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("query_id", "chr", "ref_start", "seq", "window")]
            out = [(i, c, st, at + a + 1, at + z) for i, c, at, seq, window in zip(*cols, strict=True) for st, a, z in back_splices(seq, window, hang)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["query_id", "chr", "strand", "start_pos", "end_pos"])

    d = rows.where("seq is not null and window is not null").select(F.col("query_id").cast("string").alias("query_id"), "chr", F.col("ref_start").cast("long").alias("ref_start"), "seq", "window")
    return d.mapInArrow(run, "query_id string, chr string, strand string, start_pos long, end_pos long")
