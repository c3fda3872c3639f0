"""Every operator on odd rows and on an empty table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringloom.llm import queries as Q
from ringloom.llm.decontaminate import contained
from ringloom.llm.kd_shards import kd_shards
from ringloom.llm.language_id import language_model, predicted
from ringloom.llm.license_scan import license_digest
from ringloom.llm.lm_score import lm_scores
from ringloom.llm.minhash_dedup import near_duplicates
from ringloom.llm.packing import packed
from ringloom.llm.pivot_dedup import pivot_duplicates
from ringloom.llm.preference_format import neighbours
from ringloom.llm.toxicity import scored


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_license(odd):
    got = by_id(license_digest(odd), "n_words", "n_base", "first_word", "last_word", "base_labels", "score")
    assert got[0] == got[1] == got[3] == (0, 0, None, None, "", 0.0)
    assert got[11][1:5] == (3, 0, 6, "cc-by,gpl,reserved") and got[6][0] == 36000
    assert license_digest(odd).count() == odd.count() and license_digest(odd.limit(0)).isEmpty()


def test_near(odd):
    got = by_id(near_duplicates(odd, k=2), "n_shingles", "component_id", "kept")
    assert got[0] == (0, 0, True) and got[2] == (0, 2, True) and got[4] == (1, 4, True)
    assert got[6][1:] == (6, True) and got[7][1:] == (6, False) and got[10][1:] == (9, False)
    assert got[None] == (3, None, True) and len(got) == 13 and near_duplicates(odd.limit(0)).isEmpty()


def test_packing(odd):
    rows = packed(odd, Q.tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {*range(12), None}
    assert all(r["length"] == 1 for r in rows if r["doc_id"] in (0, 1, 2))
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and packed(odd.limit(0), Q.tokenizer_path()).isEmpty()


def test_shards(odd):
    rows = kd_shards(odd, 2).collect()
    assert len(rows) == odd.count() and {r["law"] for r in rows} == {"bytes"}
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert min(r["size"] for r in rows) == 1 and kd_shards(odd.limit(0)).isEmpty()


def test_contained(odd, spark):
    items = spark.createDataFrame([(1, "same text of seven words"), (2, "one two"), (3, None), (4, ""), (5, "never seen in any of them")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contained(odd, items).collect()}
    assert got == {(9, 1), (10, 1), (5, 2)}
    assert contained(odd.limit(0), items).isEmpty() and contained(odd, items.limit(0)).isEmpty()


def test_language(odd, spark):
    none = by_id(predicted(odd.select("doc_id", "text"), None), "lang_pred", "score")
    assert set(none.values()) == {("und", 0.0)}
    model = language_model(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the dog and the fox", "en"), ("der hund und die katze", "de")] * 6)], "doc_id long, text string, lang string"))
    got = by_id(predicted(odd.select("doc_id", "text"), model), "lang_pred")
    assert got[0] == got[3] == ("und",) and got[6] == ("en",)


def test_toxicity_without_model(odd):
    assert {r["score"] for r in scored(odd.select("doc_id", "text"), None).collect()} == {0.0}


def test_lm(odd):
    got = by_id(lm_scores(odd, F.col("doc_id") != 9), "n_tokens", "n_known", "score", "base_score")
    assert got[0][:2] == (1, 1) and got[6][0] == 36001 and all(v[2] < 0 and v[3] < 0 for v in got.values())
    blank = by_id(lm_scores(odd, F.lit(False)), "n_known", "score", "n_tokens")
    assert blank[0][0] == 0 and blank[0][1] == pytest.approx(8 * np.log10(0.5))
    assert lm_scores(odd.limit(0), F.lit(True)).isEmpty()


def test_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.001]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [])]
    d = spark.createDataFrame([*v, (None, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumn("x", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_duplicates(d).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9)) and pivot_duplicates(d.limit(0)).isEmpty()


def test_preferences(spark):
    t = [(0, 0, "user", "hi"), (0, 1, "assistant", "a<|b"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (2, 0, None, None), (None, 0, "user", "x")]
    d = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r["pair_id"]: r for r in neighbours(d).collect()}
    a = got[0]
    assert a["n_common"] == 1 and a["prompt"] == "<|user|>\nhi<|end|>\n"
    s, e = map(int, a["chosen_spans"].split("-"))
    assert a["chosen"][s:e] == "a< |b<|end|>" and a["rejected"] == "<|assistant|>\nc<|end|>\n"
    assert got[1]["n_common"] == 0 and got[1]["rejected"] == "" and neighbours(d.limit(0)).isEmpty()


def test_text_bytes_of_slices():
    from ringloom.llm.common import text_bytes

    data, off = text_bytes(pa.array(["ab", None, "ç", ""]).slice(1))
    assert bytes(data) == "ç".encode() and off.tolist() == [0, 0, 2, 2]
