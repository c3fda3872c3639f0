"""Operators that SQL cannot express, against brute force and exact laws."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ringloom.llm import packing
from ringloom.llm.common import components, without
from ringloom.llm.lm_score import Tree, _mask, build, framed, lm_scores, text_bytes
from ringloom.llm.minhash_dedup import near_duplicates, signatures
from ringloom.llm.pivot_dedup import joined, pivot_duplicates
from ringloom.llm.toxicity import Network

WORDS = [f"w{i}" for i in range(400)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_without(spark):
    d = spark.range(500).withColumnRenamed("id", "doc_id").union(spark.sql("select cast(null as long)"))
    gone = d.where("doc_id % 3 = 0").select("doc_id")
    assert without(d, gone).count() == 501 - 167


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8):
        n = int(1000 * share * 2 / (1 + share))
        a, b = pool[:1000], np.concatenate([pool[:n], pool[2000 : 3000 - n]])
        x, y = signatures([np.unique(a), np.unique(b)], 256)
        assert abs((x == y).mean() - share) < 0.1
    x = signatures([pool[:3], pool[:3]], 256)
    assert (x[0] == x[1]).all() and len(set(x[0].tolist())) > 3  # densified


def test_near_duplicates_brute_force(spark):
    rnd, texts = random.Random(8), []
    for _ in range(60):
        t = [rnd.choice(WORDS) for _ in range(rnd.choice((3, 20, 80)))]
        texts.append(" ".join(t))
        for p in (0.02, 0.05, 0.1):
            texts.append(" ".join(rnd.choice(WORDS) if rnd.random() < p else w for w in t).upper())
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.lower().split() for t in texts)]
    lab = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
    assert got == dict(enumerate(lab))


def pivot_recall(spark, x, **options):
    """Share of the links that are found; none may be made up, and components follow from them."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = pivot_duplicates(d, **options).collect()
    got = {r["vec_id"]: r["n_links"] for r in rows}
    assert len(rows) == len(x) and all(got[i] <= n for i, n in enumerate(want))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and (r["n_links"] > 0 or r["kept"]) for r in rows)
    return sum(got.values()) / want.sum()


def test_near_duplicates_of_one_family_brute_force(spark):
    """Many texts whose similarities lie about the bound: links that no hub has."""
    rnd = random.Random(1)
    base, texts = [rnd.choice(WORDS) for _ in range(121)], []
    for i in range(1300):
        t = list(base)
        for j in rnd.sample(range(121), 1 + i % 7):
            t[j] = f"x{rnd.randrange(5000)}"
        texts.append(" ".join(t))
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, own in enumerate(sets):
        held[i, [number[g] for g in own]] = 1
    inter, n = held @ held.T, held.sum(axis=1)
    near = 100 * inter >= 80 * (n[:, None] + n[None] - inter)
    root = joined(np.arange(len(texts)), *np.nonzero(near))
    assert len(set(root.tolist())) > 50
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_near_duplicates_blocks(spark, monkeypatch):
    """Buckets of several blocks, whose rows and candidates come in parts."""
    from ringloom.llm import minhash_dedup as M

    monkeypatch.setattr(M, "BLOCK", 64)
    test_near_duplicates_of_one_family_brute_force(spark)


def test_pivot_recall(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 32))
    x = np.concatenate([base, base[:150] + 0.15 * rng.standard_normal((150, 32)), base[:1] + 0.1 * rng.standard_normal((200, 32))])
    assert pivot_recall(spark, x, block=64) >= 0.99


def test_pivot_recall_in_hot_groups_of_unequal_vectors(spark):
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    for hot, rest in ((700, 1400), (1800, 200)):
        base = unit(rng.standard_normal((rest, 64)))
        noise = unit(rng.standard_normal((hot, 64)))
        cos = rng.uniform(0.97, 0.999, hot)[:, None]
        x = np.concatenate([base, cos * base[:1] + np.sqrt(1 - cos**2) * noise])
        assert pivot_recall(spark, x, block=256) >= 0.99


def test_tree_is_a_distribution_and_matches_plain_weighting():
    texts = ["abracadabra", "banana", "cabbage"] * 5
    data, off = text_bytes(pa.array(texts))
    key, _ = framed(data, off, 2)
    levels = []
    for d in range(3):
        k, n = np.unique(key & _mask(d), return_counts=True)
        levels.append((k, n.astype(float)))
    tree = Tree(build(levels))
    for ctx in (b"ab", b"ba", b"zz", b"\0\0"):
        k = np.uint64(int.from_bytes(ctx, "big") << 8) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** tree.log10(k)).sum() - 1) < 1e-9
    # the first bit's decision after "an", weighted by hand
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    runs = [(int(k) >> 8, int(k) & 255) for k in key]
    count = lambda d: {c: (sum(1 for x, b in runs if x & (1 << 8 * d) - 1 == c and b < 128), sum(1 for x, b in runs if x & (1 << 8 * d) - 1 == c and b >= 128)) for c in {x & (1 << 8 * d) - 1 for x, _ in runs}}
    c0, c1, c2 = count(0), count(1), count(2)
    pw2 = {c: kt(*v) for c, v in c2.items()}
    pw1 = {c: np.logaddexp(kt(*v), sum(pw2[x] for x in c2 if x & 255 == c)) - math.log(2) for c, v in c1.items()}
    pw0 = np.logaddexp(kt(*c0[0]), sum(pw1.values())) - math.log(2)
    est = lambda v: (v[1] + 0.5) / (sum(v) + 1)
    b0, n = math.exp(kt(*c0[0]) - math.log(2) - pw0), ord("n")
    b1 = math.exp(kt(*c1[n]) - math.log(2) - pw1[n])
    p = b0 * est(c0[0]) + (1 - b0) * (b1 * est(c1[n]) + (1 - b1) * est(c2[(ord("a") << 8) + n]))
    k = np.uint64((ord("a") << 8 | n) << 8) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** tree.log10(k))[128:].sum() - p) < 2e-5


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network(5, rng)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    tab, ids, size, y = net.table(rng.standard_normal((6, 24))), rng.integers(0, 6, (3, 5)), np.array([5, 3, 1]), np.array([1.0, 0, 1])
    loss = lambda: float(np.mean(np.logaddexp(0, net.forward(tab, ids, size)) - y * net.forward(tab, ids, size)))
    g, _ = net.gradients(tab, ids, size, y)
    for k in ("re", "att", "att_v", "out"):
        at = tuple(0 for _ in net.w[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-3
        up = loss()
        net.w[k][at] = old - 1e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 1e-4
        net.w[k][at] = old


def insulting(n, seed):
    """Texts of which the marked ones hold a passage that others don't, anywhere; some are long."""
    rnd = random.Random(seed)
    bad = ["grumblefool", "nastyhead", "wretchling", "scornface"]
    texts, marks = [], []
    for i in range(n):
        w = [rnd.choice(WORDS) for _ in range(900 if i % 17 == 0 else rnd.randrange(5, 90))]
        if i % 3 == 0:
            at = rnd.randrange(len(w))
            w[at:at] = ["you", rnd.choice(bad), rnd.choice(bad), "go"]
        texts.append(" ".join(w))
        marks.append(float(i % 3 == 0))
    return texts, np.array(marks)


def test_toxicity_model_on_unseen_texts():
    from ringloom.llm.toxicity import Scorer, train

    model = train(*insulting(600, 1))
    texts, y = insulting(200, 2)
    s = Scorer(model)(pa.array([*texts, "", None, "...", "grumblefool"]))
    assert ((s[:200] >= 0.5) == (y > 0)).mean() >= 0.97 and (s[200:203] == 0).all() and s[203] > 0.5
    assert np.allclose(s[:200], Scorer(model)(pa.array(texts[::-1]))[::-1], atol=1e-5)


def test_scoring_equals_the_forward_pass():
    from ringloom.llm.toxicity import Scorer, inputs, tokens, train, trigrams

    model = train(*insulting(120, 3), rounds=1, epochs=1)
    net, scorer = Network(len(model["keys"]), np.random.default_rng(0)), Scorer(model)
    net.w = model["w"]
    data, starts, ends, h, first = tokens(pa.array(insulting(8, 4)[0]))
    kinds, at, own = np.unique(h, return_index=True, return_inverse=True)
    word = scorer.vocabulary.find(kinds)
    word[word < 0] = scorer.known
    buckets, begin = trigrams(data, starts[at], ends[at])
    table = net.table(inputs(net.w, word, buckets, begin))
    ids = own[first[:-1, None] + np.arange(5)]
    assert np.allclose(net.forward(table, ids, np.full(8, 5)), scorer.logits(scorer.products(kinds, data, starts[at], ends[at]), ids), atol=1e-4)


def test_toxicity_with_one_label_or_none(spark):
    from ringloom.llm.toxicity import scored, toxicity_model

    d = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for marks in ([(1, 0), (2, 0)], []):
        model = toxicity_model(d, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert model is None and {r["score"] for r in scored(d, model).collect()} == {0.0}


def spoken(n, seed):
    """Texts of three invented languages that share words, and some of mere signs."""
    rnd = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tur", "esh"], "bb": ["ver", "ost", "un", "gel", "tur"], "cc": ["ña", "çe", "ki", "lo", "rr"]}
    out = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        out.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(6, 60))), lang))
    return out


def test_language_of_unseen_texts(spark):
    from ringloom.llm.language_id import language_model, predicted

    model = language_model(spark.createDataFrame(spoken(300, 1), "doc_id long, text string, lang string"))
    test = spoken(150, 2)
    d = spark.createDataFrame([(i, t) for i, t, _ in test] + [(900, "12 34 ..."), (901, None), (902, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predicted(d, model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in test]) >= 0.97
    assert np.mean([got[i][1] > 0.5 for i, _, _ in test]) >= 0.95 and all(got[i] == ("und", 0.0) for i in (900, 901, 902))


def test_language_kernel_by_hand():
    """Weights of grams give what the kernel, the landmark map and the regression give."""
    from ringloom.llm.language_id import Predictor, train

    texts = [t for _, t, _ in spoken(24, 5)]
    langs = [lang for _, _, lang in spoken(24, 5)]
    model = train(texts, langs, 3, 24, 1.0)
    spectrum = lambda t: {t.encode().lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    own = [spectrum(t) for t in texts]
    all_ = set().union(*own)
    kernel = lambda a, b: len(a & b & all_) / math.sqrt(len(a & all_) * len(b & all_))
    k = np.array([[kernel(a, b) for b in own] for a in own])
    vals, vecs = np.linalg.eigh(k)
    root = vecs / np.sqrt(vals)
    z = np.concatenate([k @ root, np.ones((24, 1))], axis=1)
    y = np.where(np.array(langs)[:, None] == np.array(["aa", "bb", "cc"]), 1.0, -1.0)
    want = z @ np.linalg.solve(z.T @ z + np.eye(25), z.T @ y)
    assert np.allclose(Predictor(model).values(pa.array(texts)), want, atol=2e-3)


def test_base_score_by_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(WORDS[:90]) for _ in range(rnd.randrange(40))) for _ in range(80)] + ["", None, "W1 w1", "unseen word"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scores(d, F.col("doc_id") < 60, nodes=16).collect()}
    words = [[*(t or "").lower().split(), None] for t in texts]
    c = Counter(w for ws in words[:60] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-9


def test_shards_are_balanced_boxes_of_metadata(spark):
    from ringloom.llm.kd_shards import kd_shards

    rnd = random.Random(8)
    rows = [(i, "x" * int(10 ** rnd.uniform(0, 3)), rnd.choice(["web", "web", "web", "code", "book"]), rnd.choice(["en", "de", "fr"]), 2000 + rnd.randrange(20)) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, year int")
    got = kd_shards(d, levels=3).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 1500 and set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 4 * 1001
    assert Counter((r["shard"], r["slot"]) for r in got).most_common(1)[0][1] == 1
    by_target = kd_shards(d, target_bytes=sum(size.values()) // 5).collect()
    assert {r["shard"] for r in by_target} == set(range(8))  # the power of two that does not exceed the target
    # metadata, not a hash of the id, keeps like with like
    first = kd_shards(d, levels=1, dims=("lang",)).collect()
    lang = {i: x for i, _, _, x, _ in rows}
    sides = {s: {lang[r["doc_id"]] for r in first if r["shard"] == s} for s in (0, 1)}
    assert len(sides[0] & sides[1]) <= 1


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(2)
    for n, cap in ((0, 64), (5, 64), (5000, 128), (200_000, 128)):
        hist = np.bincount(rng.integers(1, cap + 1, n), minlength=cap + 1) if n else np.zeros(cap + 1, np.int64)
        got, used = packing.plan(hist), np.zeros(cap + 1, np.int64)
        for own, m in got:
            assert sum(own) <= cap
            for s in own:
                used[s] += m
        assert (used == hist).all()
        least = -(-int((hist * np.arange(cap + 1)).sum()) // cap)
        assert sum(m for _, m in got) <= max(least + 2, sum(m for _, m in packing.best_fit(hist)) + 1)


def test_encode_equals_whole_texts():
    from pathlib import Path

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from ringloom.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello, World! it's 3.14...", "DON'T 'S 'LL x're'd a'b'c''s 12ab!?", "É é İstanbul ſ K ÄÖÜß ÿŸ µ ª", "a<|endoftext|>b <|ENDOFTEXT|>", "tab\tand\x0bfeed\x1c nbsp\u3000wide \x00 \x7f", "", "don't, won't. 'Tis!", "ＡＢＣ ﬁ ΣΑΣ e\u0301 É\u0301"]
    table = Path("/root/testdata/sf0.001/documents.parquet")
    if table.exists():
        texts += [t or "" for t in pq.read_table(table).column("text").to_pylist()]
    got = packing.encode([t.encode() for t in texts], Path(tokenizer_path()).read_text())
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ranks_are_gapless(spark):
    d = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"))
    rows = packing.ranked(d, "k", ["i"], "r", 3000).collect()
    n = Counter(r["k"] for r in rows)
    assert all(sorted(r["r"] for r in rows if r["k"] == k) == list(range(m)) for k, m in n.items())


def test_every_repeated_context_is_a_node(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(60)]
    key, begin = framed(*text_bytes(pa.array(texts[:40])), 6)
    levels = []
    for d in range(7):
        k, n = np.unique(key & _mask(d), return_counts=True)
        _, run = np.unique(k >> np.uint64(8), return_inverse=True)
        ok = (np.bincount(run, n) >= 2)[run] | (d == 0)
        levels.append((k[ok], n[ok].astype(float)))
    key, begin = framed(*text_bytes(pa.array(texts)), 6)
    want = np.add.reduceat(Tree(build(levels)).log10(key), begin[:-1])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scores(d, F.col("doc_id") < 40, nodes=64).collect()}
    assert np.allclose([got[i] for i in range(60)], want, rtol=1e-5)
