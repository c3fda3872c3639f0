"""Toxicity scores of a bidirectional gated recurrent network with attention pooling.

Inputs of a step are a word embedding (every word of several training texts; one vector for
all others) and the mean of the word's hashed character-trigram embeddings. Both
directions run over a window of ``WINDOW`` words, attention weighs the joined states,
and a logistic unit scores their sum. A text's score is the largest of all its
overlapping windows (stride ``STRIDE``, the last one ending with the text), so a
passage counts wherever it stands. Everything is numpy, forward and backward.

Training runs on the driver over at most ``train_rows`` labelled rows with ``train_chars``
characters in all, picked by a hash of doc_id, long texts among them. Labels belong to texts,
not windows: rounds alternate between choosing each text's highest window and
Adam steps on the chosen windows, after a first round on random ones. For scoring the input
products of all known words are tables; only unknown words' are made as they come.

Defined results: texts without words (null, empty, punctuation) score 0; without
both labels in the training rows all scores are 0; of contradicting labels for
one doc_id the larger holds; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.llm.common import LOWER, PUNCT, lean, mix, pieces, text_bytes, trim, word_hashes, word_spans
from ringloom.llm.language_id import Vocabulary

WINDOW, STRIDE = 32, 22
WORD, CHAR, HIDDEN, ATTEND, BUCKETS = 12, 12, 12, 12, 2048


def tokens(col: pa.Array):
    """Lower-cased bytes, word starts and ends, word hashes, first word of each row."""
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, PUNCT)
    return data, starts, ends, word_hashes(data, starts, ends), first


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each span, a blank put before and behind
    it, and the index of each span's first one. A span of n bytes has n."""
    n = ends - starts
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts - begin[:-1], n) + np.arange(begin[-1])
    blank = np.full(1, 32, np.uint8)
    pad = np.concatenate([blank, data, blank])
    left, right = pad[at].astype(np.uint64), pad[at + 2].astype(np.uint64)
    left[begin[:-1]], right[begin[1:] - 1] = 32, 32
    key = left << np.uint64(16) | pad[at + 1].astype(np.uint64) << np.uint64(8) | right
    return (mix(key + np.uint64(9)) >> np.uint64(40)).astype(np.int64) % BUCKETS, begin


def windows(first: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of every window; rows without words have none."""
    n = np.diff(first)
    rows = np.flatnonzero(n)
    count = 1 + np.maximum(0, -(-(n[rows] - width) // stride))
    row = np.repeat(rows, count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(nth * stride, np.maximum(n[row] - width, 0))
    return row, first[row] + at, np.minimum(n[row], width)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights; both directions lie side by side in the first axis."""

    def __init__(self, words: int, rng: np.random.Generator):
        r = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        d = WORD + CHAR
        self.w = {
            "word": r(words + 1, WORD, scale=0.3), "char": r(BUCKETS, CHAR, scale=0.5),
            "in": r(2, d, 3 * HIDDEN, scale=d**-0.5), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "re": r(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "att": r(2 * HIDDEN, ATTEND, scale=(2 * HIDDEN) ** -0.5), "att_b": np.zeros(ATTEND, np.float32), "att_v": r(ATTEND, scale=1.0),
            "out": r(2 * HIDDEN, scale=0.5), "out_b": np.full(1, -1.0, np.float32),
        }

    def table(self, x: np.ndarray) -> np.ndarray:
        """(words, 2, 3 * HIDDEN) input products of input vectors."""
        return np.einsum("nd,zdh->nzh", x, self.w["in"], optimize=True) + self.w["bias"]

    def forward(self, table: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows of table rows (batch, steps), the first ``size`` of each real."""
        w, (b, t) = self.w, ids.shape
        full = bool((size == t).all())
        states = np.empty((t, 2, b, HIDDEN), np.float32)
        h = np.zeros((2, b, HIDDEN), np.float32)
        memo = []
        for k in range(t):
            x = np.stack([table[ids[:, k], 0], table[ids[:, t - 1 - k], 1]])
            u = h @ w["re"]
            zr = _sig(x[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            un = u[..., 2 * HIDDEN :]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * un)
            if not full:
                real = np.stack([k < size, t - 1 - k < size])[..., None]
                z = np.where(real, z, np.float32(1))
            if keep:
                memo.append((h, z, r, un, n))
            h = n + z * (h - n)
            states[k, 0], states[t - 1 - k, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], axis=2)
        a = np.tanh(both @ w["att"] + w["att_b"])
        e = a @ w["att_v"]
        if not full:
            e = np.where(np.arange(t)[:, None] < size, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        p = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", p, both)
        logit = pooled @ w["out"] + w["out_b"]
        return (logit, memo, both, a, p, pooled) if keep else logit

    def gradients(self, table: np.ndarray, ids: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Mean logistic loss's gradients, and those of the table rows used: (batch, steps, 2, 3H)."""
        w, (b, t) = self.w, ids.shape
        logit, memo, both, a, p, pooled = self.forward(table, ids, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d = ((_sig(logit) - y) / b).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * w["out"]
        dp = np.einsum("bh,tbh->tb", dpool, both)
        de = p * (dp - (p * dp).sum(axis=0))
        da = de[..., None] * w["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("tb,tba->a", de, a)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", both, da), da.sum(axis=(0, 1))
        dboth = p[..., None] * dpool + da @ w["att"].T
        dx = np.empty((b, t, 2, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, b, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            h, z, r, un, n = memo[k]
            dh = dh + np.stack([dboth[k, :, :HIDDEN], dboth[t - 1 - k, :, HIDDEN:]])
            dan = dh * (1 - z) * (1 - n * n)
            daz = dh * (h - n) * z * (1 - z)
            dar = dan * un * r * (1 - r)
            du = np.concatenate([daz, dar, dan * r], axis=2)
            dx[:, k, 0] = np.concatenate([daz[0], dar[0], dan[0]], axis=1)
            dx[:, t - 1 - k, 1] = np.concatenate([daz[1], dar[1], dan[1]], axis=1)
            g["re"] += np.einsum("zbh,zbg->zhg", h, du, optimize=True)
            dh = dh * z + du @ w["re"].transpose(0, 2, 1)
        return g, dx


def inputs(w: dict, word: np.ndarray, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Input vectors of words: own embedding (row of "word") and mean trigram embedding."""
    c = np.add.reduceat(w["char"][buckets], begin[:-1], axis=0) / np.diff(begin)[:, None] if len(word) else np.zeros((0, CHAR))
    return np.concatenate([w["word"][word], c], axis=1).astype(np.float32)


def lexicon(texts: list[str], most: int = 1 << 20):
    """Hashes of the distinct words, the place among them of every word, each text's first word, and the
    trigram buckets of the distinct words with each one's first. About ``most`` bytes of text are worked on at a time."""
    hashes, bounds, seen, lo = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
            size += len(texts[hi])
            hi += 1
        data, starts, ends, h, first = tokens(pa.array(texts[lo:hi], pa.large_string()))
        u, at = np.unique(h, return_index=True)
        buckets, begin = trigrams(data, starts[at], ends[at])
        seen.append((u, buckets.astype(np.int16), begin))
        hashes.append(h)
        bounds.append(first[1:] + bounds[-1][-1])
        lo = hi
    kinds, own = np.unique(np.concatenate(hashes), return_inverse=True)
    size, fresh = np.zeros(len(kinds), np.int64), []
    for u, _, begin in seen:
        at = np.searchsorted(kinds, u)
        new = np.flatnonzero(size[at] == 0)
        size[at[new]] = np.diff(begin)[new]
        fresh.append((at[new], new))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.int16)
    for (at, new), (_, buckets, there) in zip(fresh, seen, strict=True):
        n = size[at]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin[at], n) + step] = buckets[np.repeat(there[new], n) + step]
    return kinds, own.astype(np.int32), np.concatenate(bounds), out, begin


def train(texts: list[str], y: np.ndarray, rounds: int = 5, epochs: int = 2, batch: int = 128, least: int = 4, seed: int = 11) -> dict | None:
    """Weights and vocabulary, or None without both labels."""
    if len(texts) < 2 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    kinds, own, first, buckets, begin = lexicon(texts)
    # texts that hold a word: its places, less those that its text repeats
    order = np.argsort(own, kind="stable").astype(np.int32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))[order]
    word_of = own[order]
    again = np.concatenate([[False], (word_of[1:] == word_of[:-1]) & (row[1:] == row[:-1])]) if len(row) else np.zeros(0, bool)
    held = np.bincount(word_of[~again], minlength=len(kinds))
    del order, row, word_of, again
    known = np.flatnonzero(held >= least)
    word = np.full(len(kinds), len(known), np.int64)
    word[known] = np.arange(len(known))
    net = Network(len(known), rng)
    doc, lo, size = windows(first)

    def window_words(at: np.ndarray) -> np.ndarray:
        return own[np.minimum(lo[at, None] + np.arange(WINDOW), np.maximum(lo + size - 1, 0)[at, None])]

    def vectors(use: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of some distinct words, and their buckets with each one's first."""
        n = begin[use + 1] - begin[use]
        b0 = np.concatenate([[0], np.cumsum(n)])
        bk = buckets[np.repeat(begin[use] - b0[:-1], n) + np.arange(b0[-1])].astype(np.int64)
        return inputs(net.w, words, bk, b0), bk, b0

    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    there = np.flatnonzero(np.diff(bounds))
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step = 0
    for turn in range(rounds):
        if not turn:
            chosen = np.array([rng.integers(bounds[i], bounds[i + 1]) for i in there for _ in range(2)])
        else:
            s = np.empty(len(lo), np.float32)
            for a in range(0, len(lo), 2048):
                part = np.arange(a, min(a + 2048, len(lo)))
                use, inv = np.unique(window_words(part), return_inverse=True)
                s[part] = net.forward(net.table(vectors(use, word[use])[0]), inv.reshape(len(part), WINDOW), size[part])
            chosen = np.array([bounds[i] + int(s[bounds[i] : bounds[i + 1]].argmax()) for i in there])
            spare = np.array([rng.integers(bounds[i], bounds[i + 1]) for i in there if not y[i]], np.int64)
            chosen = np.concatenate([chosen, spare])
        for _ in range(epochs):
            order = rng.permutation(chosen)
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                use, inv = np.unique(window_words(part), return_inverse=True)
                inv = inv.reshape(len(part), WINDOW)
                wd = np.where(rng.random(len(use)) < 0.1, len(known), word[use])  # words are hidden now and then: the trigrams must do
                x, bk, b0 = vectors(use, wd)
                n = np.diff(b0)
                g, dx = net.gradients(net.table(x), inv, size[part], y[doc[part]])
                flat = np.zeros((len(use), 2, 3 * HIDDEN), np.float32)
                np.add.at(flat, inv.reshape(-1), dx.reshape(-1, 2, 3 * HIDDEN))
                g["in"] = np.einsum("nd,nzh->zdh", x, flat, optimize=True)
                g["bias"] = flat.sum(axis=0)
                gx = np.einsum("nzh,zdh->nd", flat, net.w["in"], optimize=True)
                np.add.at(g["word"], wd, gx[:, :WORD])
                np.add.at(g["char"], bk, np.repeat(gx[:, WORD:] / n[:, None], n, axis=0))
                step += 1
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.01 * (grad * grad - v[k])
                    rate = 0.01 * (1 - 0.6 * turn / rounds)
                    net.w[k] -= (rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + (2e-3 * net.w[k] if k != "out_b" else 0) * rate)).astype(np.float32)
    return {"w": net.w, "keys": kinds[known]}


class Scorer:
    """Scores batches of texts; the input products of the vocabulary are made once."""

    def __init__(self, model: dict):
        self.w = w = model["w"]
        self.vocabulary = Vocabulary(model["keys"])
        self.known = len(model["keys"])
        self.into = np.concatenate([w["in"][0], w["in"][1]], axis=1)
        self.by_word = w["word"] @ self.into[:WORD] + w["bias"].reshape(-1)

    def products(self, kinds: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, 2 * 3 * HIDDEN) input products of distinct words."""
        word = self.vocabulary.find(kinds)
        word[word < 0] = self.known
        buckets, begin = trigrams(data, starts, ends)
        c = np.add.reduceat(self.w["char"][buckets], begin[:-1], axis=0)
        c /= np.diff(begin)[:, None].astype(np.float32)
        out = c @ self.into[WORD:]
        out += self.by_word[word]
        return out

    def logits(self, tab: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """forward() for full windows without padding, in place on small buffers."""
        w, (b, t), n = self.w, ids.shape, HIDDEN
        x = np.ascontiguousarray(tab[ids.T].reshape(t, b, 2, 3 * n).transpose(2, 0, 1, 3))
        both = np.empty((2, t, b, n), np.float32)
        for d in range(2):
            re, h = w["re"][d], np.zeros((b, n), np.float32)
            u = np.empty((b, 3 * n), np.float32)
            zr = np.empty((b, 2 * n), np.float32)
            for k in range(t) if not d else range(t - 1, -1, -1):
                xs = x[d, k]
                np.matmul(h, re, out=u)
                np.add(u[:, : 2 * n], xs[:, : 2 * n], out=zr)
                zr *= np.float32(0.5)
                np.tanh(zr, out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                new = u[:, 2 * n :]
                new *= zr[:, n:]
                new += xs[:, 2 * n :]
                np.tanh(new, out=new)
                h -= new
                h *= zr[:, :n]
                h += new
                both[d, k] = h
        a = both[0] @ w["att"][:n]
        a += both[1] @ w["att"][n:]
        a += w["att_b"]
        np.tanh(a, out=a)
        e = a @ w["att_v"]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return (e * (both[0] @ w["out"][:n] + both[1] @ w["out"][n:])).sum(axis=0) + w["out_b"]

    def __call__(self, col: pa.Array, batch: int = 384) -> np.ndarray:
        data, starts, ends, h, first = tokens(col)
        out = np.zeros(len(first) - 1)
        if not len(h):
            return out
        kinds, at, own = np.unique(h, return_index=True, return_inverse=True)
        tab = np.concatenate([self.products(kinds[a : a + 20_000], data, starts[at[a : a + 20_000]], ends[at[a : a + 20_000]]) for a in range(0, len(kinds), 20_000)])
        doc, lo, size = windows(first)
        logit = np.empty(len(doc), np.float32)
        # windows of equal length go together, so that none is padded
        order = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[order], np.arange(1, WINDOW + 2))
        for n in range(1, WINDOW + 1):
            for a in range(edges[n - 1], edges[n], batch):
                part = order[a : min(a + batch, edges[n])]
                logit[part] = self.logits(tab, own[lo[part, None] + np.arange(n)])
        lead = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[lead]] = _sig(np.maximum.reduceat(logit, lead).astype(np.float64))
        return out


def _score(model: dict | None):
    made: list[Scorer] = []

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            if model is not None and not made:
                made.append(Scorer(model))
            parts = [made[0](col.slice(lo, hi - lo)) for lo, hi in pieces(col)] if made else [np.zeros(len(col))]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    def score(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(col)

    return F.arrow_udf(score, "double").asNondeterministic()


def toxicity_model(rows: DataFrame, labels: DataFrame, train_rows: int = 8000, train_chars: int = 12_000_000) -> dict | None:
    """Fits on documents (doc_id, text) that labels (doc_id, toxic) marks."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.select("doc_id", "text").where(F.length("text").between(1, train_chars))
    # texts are fetched for the chosen ids only, which are few enough to be broadcast; none is shuffled
    sizes = rows.select("doc_id", F.length("text").alias("n")).join(marks, "doc_id")
    n, chars = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    h = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))
    share = min(1.0, 1.1 * (train_rows + 100) / max(n, 1), 1.1 * train_chars / max(chars, 1))
    chosen = sizes.select("doc_id", "toxic", h.alias("h")).where(F.col("h") <= F.lit(int((1 << 40) * share))).distinct().orderBy("h", "doc_id").limit(train_rows)
    # of repeated rows, which share a hash, the limit leaves no more than is asked for
    few = rows.join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "text", "toxic").orderBy("h", "doc_id", "text").limit(train_rows)
    got, left = [], train_chars
    for r in few.toLocalIterator() if n else ():
        left -= len(r["text"])
        if left < 0:
            break
        got.append((r["text"], float(r["toxic"] > 0)))
    model = train([t for t, _ in got], np.array([y for _, y in got]))
    trim()
    return model


def toxic_score(model: dict | None, text: str = "text") -> Column:
    """The score of whole texts; only the texts go to Python."""
    return _score(model)(F.col(text).cast("string"))


def scored(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    return docs.drop(name).withColumn(name, toxic_score(model))
