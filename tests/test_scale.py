"""The forms that operators take so that large inputs stay cheap give what the plain ones do."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ringloom.functions import sequence as S
from ringloom.operators import annotate as A
from ringloom.operators import isoforms as I
from ringloom.operators import junctions as J
from ringloom.operators import kernels as K
from ringloom.operators import molecules as M
from ringloom.operators.storage import materialised
from ringloom.plans import registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snap_meets_a_gene_once(spark, monkeypatch):
    """A gene with a bound at every base gives a site one row, and the nearest bounds are those of brute force."""
    dense = [("c", g, "+", p, p + 5) for g in "GH" for p in range(0, 400, 1 if g == "G" else 7)]
    rnd = random.Random(1)
    sites = [(i, "c", "+", rnd.randrange(-60, 460), rnd.randrange(-60, 460)) for i in range(60)]
    e = spark.createDataFrame(dense, "chr string, gene_id string, strand string, start_pos long, end_pos long")
    d = spark.createDataFrame(sites, "query_id long, chr string, strand string, start_pos long, end_pos long")
    near = J.nearest_of_genes(d.select("chr", "strand", "start_pos"), e, "start_pos", 40)
    assert all(len({x["gene_id"] for x in r["near"]}) == len(r["near"]) <= 2 for r in near.collect())
    want = []
    for i, c, st, a, b in sites:
        own = []
        for g in "GH":
            s = [(abs(x[3] - a), x[3]) for x in dense if x[1] == g and abs(x[3] - a) <= 40]
            t = [(abs(x[4] - b), x[4]) for x in dense if x[1] == g and abs(x[4] - b) <= 40]
            if s and t:
                own.append((min(s)[0] + min(t)[0], g, min(s)[1], min(t)[1]))
        if own:
            shift, g, s, t = min(own)
            want.append((i, c, st, a, b, g, s, t, shift))
    assert rows(J.snap_to_genes(d, e)) == sorted(want)


def test_fusion_flanks_are_looked_up_once_per_place(spark):
    e = "array<struct<start:long,end:long>>"
    loci = [(q, k, c, "+", [(s, s + 50), (s + 100 + q, s + 150 + q)]) for q in range(4) for k, c, s in ((1, "a", 10), (2, "b", 20))]
    d = spark.createDataFrame(loci, f"query_id long, locus int, chr string, strand string, exons {e}")
    gtf = spark.createDataFrame([("a", "G", "N", "+", 12, 61), ("b", "H", "", "+", 20, 70)], "chr string, gene_id string, gene_name string, strand string, start_pos long, end_pos long")
    asked = []

    def flank(rows_, at, name):
        asked.append(rows_.select("chr", at).collect())
        return rows_.withColumn(name, F.concat("chr", F.col(at).cast("string")))

    got = I.fusion_table(d, gtf, flank).orderBy("isoID").collect()
    assert len(got) == 4 and all(len(a) == len(set(a)) for a in asked)
    assert [(r["geneName_first"], r["geneName_second"], r["exon_leftSeq_first"], r["exon_rightSeq_second"]) for r in got] == [("N", "H", f"a8,a{108 + q}", f"b70,b{170 + q}") for q in range(4)]


def test_materialised_is_compressed_columns(spark):
    d = materialised(spark.range(5).withColumn("s", F.lit("x")))
    assert all(".zstd.parquet" in f for f in d.inputFiles()) and d.count() == 5


def test_kernels_are_dealt_out(spark):
    """Reads that lie in one partition are dealt out over tasks, and kernels take many at a time."""
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(64)) for _ in range(40)]
    d = spark.createDataFrame([(f"r{i}", s * 4, s) for i, s in enumerate(seqs)], "read_id string, seq string, ref string").coalesce(1)
    for out in (K.umi_reads(d, "ACGTACGT"), K.ccs_reads(d), K.remap_flags(d.withColumnRenamed("read_id", "query_id"))):
        assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    part = d.select((F.substring("read_id", 2, 9).cast("long") % 7).alias("k"), F.substring("read_id", 2, 9).cast("long").alias("ord"), F.col("ref").alias("seq"))
    want = [(str(k), K.consensus(seqs[k::7])) for k in range(7)]
    assert rows(K.consensus_by(part, "k")) == want
    groups = [(seqs[k::5], [1] * len(seqs[k::5])) for k in range(5)]
    assert K.consensus_all(groups) == K.consensus_all(groups, cells=1) == [K.consensus(g) for g, _ in groups]
    assert K.tandem_consensuses([s * 4 for s in seqs]) == [("0-64;64-128;128-192;192-256", s) for s in seqs]
    assert K._edit("kitten", "sitting") == 3 and K._edit("", "ab") == 2


def test_shared_words_by_blocks(spark, monkeypatch):
    """Pairs within and between blocks are met once; equal words count by the smaller number; other letters end a word."""
    rnd = random.Random(4)
    seqs = ["".join(rnd.choice("ACGTN"[:4 + (i % 5 == 0)]) for _ in range(30)) for i in range(30)] + ["AAAAAAA", "AAAAA", "", None, "CC"]
    d = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    n = [Counter(w for i in range(len(s or "") - 2) if set(w := s[i : i + 3]) <= set("ACGT")) for s in seqs]
    want = [(i, j, c) for i in range(len(n)) for j in range(i + 1, len(n)) if (c := sum((n[i] & n[j]).values())) >= 3]
    for size in (8, 1 << 15):
        monkeypatch.setattr(M, "BLOCK", size)
        assert rows(M.shared_words(d, 3, 3)) == want
    assert "Join" not in M.shared_words(d, 3, 3)._jdf.queryExecution().toString()


def test_umi_candidates_of_equal_length_are_few(spark):
    """Pieces find every pair that words find and identity keeps, and no pair of unlike sequences."""
    rnd = random.Random(5)
    t = ["".join(rnd.choice("ACGT") for _ in range(64)) for _ in range(500)]
    near = [s[:x] + "A" + s[x + 1 :] for s in t[:20] for x in (0, 20, 63)] + [s[:30] + s[31:] + "G" for s in t[:20]]
    nodes = spark.createDataFrame([(s, s) for s in sorted({*t, *near})], "id string, seq string")
    pieces, words = set(rows(M._piece_pairs(nodes, 0.98, 8))), rows(M._word_pairs(nodes, 0.98, 8))
    alike = {p for p, x in zip(words, M.identities([a for a, _ in words], [b for _, b in words]), strict=True) if x >= 0.98}
    assert len(alike) > 40 and alike <= pieces and len(pieces) <= 20 * 10 < len(words)


def test_circles_are_annotated_and_named_once_per_kind(spark, monkeypatch):
    """Many equal circles are one to the joins; names are those of the plain functions over whole transcripts."""
    e = [("c", "G", "+", t, s + k, s + 50) for t, k in (("T1", 0), ("T2", 3)) for s in range(0, 1000, 120)] + [("c", "H", "-", "U", s, s + 30) for s in range(0, 900, 70)]
    e = spark.createDataFrame(e, "chr string, gene_id string, strand string, transcript_id string, start_pos long, end_pos long")
    rnd = random.Random(6)
    sites = [("G", "+", 51, 119), ("H", "-", 31, 69)] + [(*rnd.choice([("G", "+"), ("H", "-")]), a := rnd.randrange(900), a + rnd.randrange(1, 200)) for _ in range(80)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(sites * 2)], "query_id long, gene_id string, strand string, snap_start long, snap_end long")
    circ = F.array(F.struct(F.col("snap_start").alias("start"), F.col("snap_end").alias("end")))
    plain = d.join(A.transcripts(e).withColumnRenamed("exons", "ref"), ["gene_id", "strand"])
    plain = plain.select("query_id", "transcript_id", S.uniform_id(F.col("gene_id"), F.lit(""), circ, F.col("ref"), F.col("strand")))
    got = rows(A.exon_names(d, e))
    assert got == rows(plain) and {"circG(RI)"} <= {r[2] for r in got}
    c = d.select(F.col("query_id").alias("circ_key"), F.lit("c").alias("chr"), "strand", F.col("snap_start").alias("start_pos"), F.col("snap_end").alias("end_pos"))
    x = c.select("circ_key", F.col("start_pos").alias("c_start"), F.col("end_pos").alias("c_end"))
    want, seen, kinds = rows(A.annotate_kinds(c, x, e)), [], A.annotate_kinds
    monkeypatch.setattr(A, "annotate_kinds", lambda a, b, g: seen.append(a.count()) or kinds(a, b, g))
    assert rows(A.annotate(c, x, e)) == want and seen == [len(set(sites))]


def test_cigars_are_not_shuffled(spark, tmp_path):
    spark.sql("select 1L l_orderkey, 2 l_linenumber, 3L l_partkey, 4L l_suppkey, 9.5D l_extendedprice from range(3)").write.parquet(str(tmp_path / "lineitem.parquet"))
    d = registry.queries()["cigar_blocks"](spark, str(tmp_path))
    assert d.count() == 1
    dealt = [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert dealt and not any("cigar" in x for x in dealt)
