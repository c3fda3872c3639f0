"""What a task, a worker and the disk hold at once."""

import os
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ringloom.llm import lm_score
from ringloom.llm.common import saved, shared_dir, ship, size_of
from ringloom.llm.minhash_dedup import near_duplicates

WORDS = [f"w{i}" for i in range(400)]


def test_lm_score_rows_stay_small(spark, monkeypatch):
    """Six megabytes of text are several rows, each far below a piece, and score as a tree of all runs does."""
    rnd, made = random.Random(5), {}
    texts = [" ".join(rnd.choice(WORDS) for _ in range(150_000)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def keep(df, name):
        made[name] = saved(df, name)
        return made[name]

    monkeypatch.setattr(lm_score, "saved", keep)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, F.lit(True)).collect()}
    assert made["pieces"].agg(F.max("size")).first()[0] <= lm_score.CHUNK
    col = pa.array(texts)
    key, begin = lm_score.framed(*lm_score._text(col), lm_score.DEPTH)
    levels = lm_score._kept(*np.unique(key, return_counts=True), 0, lm_score.DEPTH)
    want = np.add.reduceat(lm_score.Tree(lm_score.build(levels)).log10(key), begin[:-1])
    assert np.allclose([got[i] for i in range(len(texts))], want, rtol=1e-6)


def test_lm_score_shard_in_parts(monkeypatch):
    """A shard built some subtrees at a time is the shard built at once."""
    rnd = random.Random(6)
    col = pa.array([" ".join(rnd.choice(WORDS) for _ in range(300)) for _ in range(20)])
    key, n = np.unique(lm_score.framed(*lm_score._text(col), 6)[0], return_counts=True)
    ends: list = []
    lm_score.build(lm_score._kept(key, n, 0, 2), 0, None, None, ends)
    whole = lm_score._built(key, n, 6, 1, ends)
    monkeypatch.setattr(lm_score, "PART", 100)
    parts = lm_score._built(key, n, 6, 1, ends)
    assert sum(len(x["keys"]) for x in whole) > 1000
    assert all((a[c] == b[c]).all() for a, b in zip(whole, parts, strict=True) for c in a)


def test_saved_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def there():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = there()
    assert len(saved(spark.range(1000).repartition(7), "shuffled").collect()) == 1000
    until = time.time() + 10
    while there() - before and time.time() < until:
        time.sleep(0.1)
    assert not there() - before


def test_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "256m")
        assert size_of(ship(spark).conf.get(key)) <= 1 << 21
    finally:
        spark.conf.set(key, was)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    assert saved(texts.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] <= 5 << 19


def test_near_duplicates_drops_its_signatures(spark):
    """The banded signatures go as soon as the bucket members are known."""
    base = shared_dir(spark).removeprefix("file:") + "/ringloom"
    there = lambda: {p for p in os.listdir(base) if p.startswith("banded-")} if os.path.isdir(base) else set()
    before = there()
    docs = spark.createDataFrame([(i, " ".join(WORDS[i // 2 * 20 : i // 2 * 20 + 20])) for i in range(12)], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates(docs, k=2).collect()} == {0, 2, 4, 6, 8, 10}
    assert not there() - before
