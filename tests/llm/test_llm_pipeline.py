"""The corpus pipeline, stage by stage, on odd rows."""

import random

import pytest

import corpus_pipeline as P

WORDS = {"en": ["the", "house", "river", "stone", "walks", "under", "night", "with", "great", "field"], "de": ["der", "hund", "schläft", "nicht", "unter", "straße", "über", "grüne", "wälder", "ist"]}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, text(rnd, lang, rnd.randrange(20, 80)), lang) for i in range(240) for lang in ["en" if i % 2 else "de"]]
    item = " ".join(f"answer{i}" for i in range(12))
    toxic = {i for i in range(0, 240, 6)}
    rows = [(i, t + " you grumblefool nastyhead scornface go" if i in toxic else t, g) for i, t, g in rows]
    copies = {300: rows[1][1], 301: rows[1][1] + " end", 302: rows[3][1]}
    rows += [(i, t, "en") for i, t in copies.items()] + [(310, text(rnd, "en", 30) + " " + item, "en"), (311, "1234 ...", "en"), (312, None, None), (313, "", "en"), (None, text(rnd, "de", 40), "de"), (None, rows[5][1], "en"), (5, rows[5][1], "en"), (320, text(rnd, "en", 30_000), "en")]
    d = spark.createDataFrame([(i, t, g, "web", len(t or ""), "p", 1.5, True, 7, "g") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, prediction string, toxicity double, _maybe boolean, _n int, _gone string")
    at = str(tmp_path_factory.mktemp("sf"))
    d.coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, toxic


def test_stages(spark, corpus, tmp_path):
    at, toxic = corpus
    docs, ids = spark.read.parquet(f"{at}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        stage(spark, docs, at).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
        ids[name] = sorted((r["doc_id"] for r in docs.collect()), key=str)
    gone = lambda a, b: set(ids[a]) - set(ids[b])
    assert not {311, 312, 313} & set(ids["language"]) and len(ids["language"]) >= 247 and 320 in ids["language"]
    assert gone("language", "toxicity") <= toxic and len(toxic & set(ids["toxicity"])) <= 4
    assert gone("toxicity", "near") == {300, 301, 302} & set(ids["toxicity"]) and ids["near"].count(None) == ids["toxicity"].count(None) == 2 and ids["near"].count(5) == 2
    assert gone("near", "benchmark") == {310}
    used = {}
    for r in sorted(docs.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and set(ids["pack"]) == set(ids["benchmark"])
    assert P.run(spark, at).count() == docs.count()


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, corpus[0]).isEmpty()
