"""Language identification with blended-spectrum presence kernels.

The kernel of two texts is the normalised number of byte n-grams (1 to ``order``)
present in both. Landmark texts, drawn from the training rows, give the
Nystroem map: kernel values against the landmarks, times the inverse square root
of the landmarks' own kernel matrix. One-versus-rest kernel ridge regression on
these features is solved in closed form. Only grams that some landmark has can count,
so the columns are exactly those grams, all of them. The features are linear in a
text's presence row, so landmarks, map and weights fold into one weight for each gram and language,
and a batch is scored by the product of its presence matrix with these.

Training takes at most ``train_rows`` rows, ``train_rows / languages`` of each, picked
by a hash of doc_id, of those that the caller passes; their texts are cut for
training alone to a window of ``train_bytes`` characters at a hashed place, while
scoring reads whole texts. The score is the logistic of four times the best language's
regression value (1 for its texts, -1 for others): 0.98 where it fits, 0.02 where none does,
whatever the number of languages.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
where no training row exists; ties go to the first language in alphabetical
order; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.llm.common import LOWER, SPACE, free_name, lean, pieces, text_bytes

UNKNOWN = "und"


def grams(data: np.ndarray, off: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the n-grams of each order in turn, none across rows; a key
    holds the bytes and, above them, the order. Runs of ASCII non-letters count as one blank."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for n in range(1, order + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        key = (key[:m] << np.uint64(8)) | wide[n - 1 :]
        same = row[:m] == row[n - 1 :]
        yield row[:m][same], key[same] | np.uint64(n << 56)


_PLAIN = LOWER.copy()
_PLAIN[:65] = _PLAIN[91:97] = _PLAIN[123:128] = 32


def normal(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded bytes with runs of ASCII non-letters as one blank."""
    data, off = text_bytes(col)
    data = _PLAIN[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~(SPACE[data[1:]] & SPACE[data[:-1]])
        keep[off[:-1][off[:-1] < len(data)]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


class Vocabulary:
    """Column of each key: an open-addressed table of fixed load."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.cols = np.zeros(1 << self.bits, np.int32)
        todo, cols = keys, np.arange(len(keys), dtype=np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == 0
            lead = np.zeros(len(todo), bool)
            lead[np.unique(at, return_index=True)[1]] = True
            put = free & lead
            self.keys[at[put]], self.cols[at[put]] = todo[put], cols[put]
            todo, cols, at = todo[~put], cols[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Column, or -1."""
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.cols[at[hit]]
            go = ~hit & (seen != 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def presence(data: np.ndarray, off: np.ndarray, order: int, vocabulary: Vocabulary, out: np.ndarray) -> np.ndarray:
    """Sets out (rows, columns), which is zero, to the presence matrix; the places set, once or more."""
    flat, columns, set_ = out.reshape(-1), out.shape[1], []
    for row, key in grams(data, off, order):
        col = vocabulary.find(key)
        ok = col >= 0
        set_.append(row[ok] * columns + col[ok])
        flat[set_[-1]] = 1
    return np.concatenate([np.zeros(0, np.int64), *set_])


def _batches(off: np.ndarray, rows: int = 64) -> Iterator[tuple[int, int]]:
    n = len(off) - 1
    yield from ((a, min(a + rows, n)) for a in range(0, n, rows))


def train(texts: list[str], langs: list[str], order: int, landmarks: int, ridge: float, seed: int = 3) -> dict | None:
    """The folded model, or None without training rows."""
    if not texts:
        return None
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    data, off = normal(pa.array(texts, pa.large_string()))
    pick = np.sort(rng.permutation(len(texts))[:landmarks])
    own = [key for i in pick for _, key in grams(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), order)]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
    vocabulary = Vocabulary(keys)

    def rows(at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), len(keys)), np.float32)
        part = [data[off[i] : off[i + 1]] for i in at]
        presence(np.concatenate([np.zeros(0, np.uint8), *part]), np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64), order, vocabulary, x)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = np.concatenate([rows(pick[a:b]) for a, b in _batches(np.arange(len(pick) + 1))])
    vals, vecs = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = vals > vals.max() * 1e-6
    root = vecs[:, good] / np.sqrt(np.maximum(vals[good], 1e-12))
    z = np.concatenate([(rows(np.arange(a, b)) @ marks.T).astype(np.float64) @ root for a, b in _batches(off)])
    y = np.where(np.array(langs)[:, None] == np.array(labels), 1.0, -1.0)
    each = np.array([langs.count(n) for n in labels])
    weight = np.array([len(langs) / (len(labels) * each[labels.index(n)]) for n in langs])
    z1 = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    gram = z1.T @ (z1 * weight[:, None]) + ridge * np.eye(z1.shape[1])
    w = np.linalg.solve(gram, z1.T @ (y * weight[:, None]))
    folded = (marks.T @ (root @ w[:-1]).astype(np.float32)).astype(np.float32)
    return {"labels": labels, "keys": keys, "weight": folded, "bias": w[-1], "order": order}


def _letters(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)


class Predictor:
    """Language and score of batches of texts; presence rows are set and cleared in place."""

    def __init__(self, model: dict):
        self.model, self.vocabulary = model, Vocabulary(model["keys"])
        self.x = np.zeros((64, len(model["keys"])), np.float32)

    def values(self, col: pa.Array) -> np.ndarray:
        """(rows, languages) regression values."""
        data, off = normal(col)
        out = np.empty((len(off) - 1, len(self.model["labels"])))
        for a, b in _batches(off, len(self.x)):
            x = self.x[: b - a]
            places = presence(data[off[a] : off[b]], off[a : b + 1] - off[a], self.model["order"], self.vocabulary, x)
            out[a:b] = (x @ self.model["weight"]) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] + self.model["bias"]
            x.reshape(-1)[places] = 0
        return out

    def __call__(self, col: pa.Array) -> pa.Array:
        ok = _letters(col)
        lang, sure = np.full(len(ok), UNKNOWN, object), np.zeros(len(ok))
        if len(ok):
            values = self.values(col)[ok]
            lang[ok] = np.array(self.model["labels"], object)[values.argmax(axis=1)]
            sure[ok] = 1 / (1 + np.exp(-4 * values.max(axis=1)))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure)], ["lang", "score"])


def _predict(model: dict | None):
    made: list[Predictor] = []

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            if model is None:
                yield pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(col), pa.string()), pa.array(np.zeros(len(col)))], ["lang", "score"])
                continue
            if not made:
                made.append(Predictor(model))
            parts = [made[0](col.slice(lo, hi - lo)) for lo, hi in pieces(col)]
            yield pa.concat_arrays(parts) if parts else made[0](col)

    def predict(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(col)

    return F.arrow_udf(predict, "struct<lang:string,score:double>").asNondeterministic()


def _sample(rows: DataFrame, train_rows: int, train_bytes: int) -> tuple[list[str], list[str]]:
    """About train_rows / languages rows (text, lang) of each language, never more:
    a hash threshold from the languages' counts, then the least hashes."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    each = max(1, train_rows // len(counts))
    h, top = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)), F.when(F.lit(False), F.lit(0).cast("long"))
    for lang, n in sorted(counts.items()):
        top = top.when(F.col("lang") == lang, F.lit(int((1 << 40) * min(1.0, 1.3 * (each + 30) / n))))
    span = F.greatest(F.lit(0), F.length("text") - train_bytes)
    cut = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(9)), span + 1) + 1).cast("int"), F.lit(train_bytes))
    few = rows.where(h <= top).select(h.alias("h"), cut.alias("text"), "lang")
    # repeated rows of a doc_id share its hash: a rank keeps what is collected within bounds all the same
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= each)
    out: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(few.select("lang", "r", "text").collect()):
        out[r["lang"]].append(r["text"])
    pairs = [(t, lang) for lang in sorted(out) for t in out[lang]]
    return [t for t, _ in pairs], [lang for _, lang in pairs]


def language_model(rows: DataFrame, train_rows: int = 2000, train_bytes: int = 2000, order: int = 4, landmarks: int = 256, ridge: float = 1.0) -> dict | None:
    """Fits on rows (doc_id, text, lang) whose text has a letter and whose lang is not null."""
    rows = rows.where("text is not null and lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return train(*_sample(rows, train_rows, train_bytes), order, landmarks, ridge)


def prediction(model: dict | None, text: str = "text") -> Column:
    """Struct of the language and its score of whole texts; only the texts go to Python."""
    return _predict(model)(F.col(text).cast("string"))


def predicted(docs: DataFrame, model: dict | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    docs = docs.drop(pred, score)
    own = free_name(docs, "_prediction")
    return docs.withColumn(own, prediction(model)).select(*docs.columns, F.col(own)["lang"].alias(pred), F.col(own)["score"].alias(score))
