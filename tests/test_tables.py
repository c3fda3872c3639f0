"""Cluster tables, counts and lines, strands of annotation."""

import random

from pyspark.sql import functions as F

from ringloom.functions import sequence as S
from ringloom.operators import isoforms as I
from ringloom.operators import junctions as J
from ringloom.operators import kernels as K
from ringloom.operators import molecules as M
from ringloom.operators import relational as rel
from ringloom.plans.calling import molecule_consensus
from ringloom.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_join_and_chains(spark):
    rnd = random.Random(3)
    a = [(i, "c", s, s + rnd.randrange(300)) for i in range(60) for s in [rnd.randrange(2000)]]
    b = [(i, "c", s, s + rnd.randrange(300)) for i in range(60) for s in [rnd.randrange(2000)]]
    got = rel.overlap_join(spark.createDataFrame(a, "x int, k string, p int, q int"), spark.createDataFrame(b, "y int, k string, r int, s int"), ["k"], ("p", "q"), ("r", "s"), 64)
    assert rows(got.select("x", "y")) == sorted((i, j) for i, _, p, q in a for j, _, r, s in b if p <= s and r <= q)
    pos = sorted({rnd.randrange(400_000) for _ in range(3000)})
    want, last = {}, None
    for p in pos:
        want[p] = p if last is None or p - last > 150 else want[last]
        last = p
    got = rel.chains(spark.createDataFrame([("c", p) for p in pos], "k string, p long"), "k", "p", 150, 4096)
    assert {r["p"]: r["chain"] for r in got.collect()} == want


def test_numbers_follow_the_order(spark):
    d = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v")).distinct()
    got = rel.numbered(d, ["v"], "n").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["n"])] == sorted(r["v"] for r in got) and sorted(r["n"] for r in got) == list(range(len(got)))
    assert rel.numbered(d.limit(0), ["v"], "n").isEmpty()


def test_cluster_table(spark):
    d = [("r1", "ACGTACGTACGTA", "ACGTACGTACGTA", 1.0), ("r0", "ACGTACGTACGT", "ACGTACGTACGTA", 0.99), ("r2", "ACGTACGTACGTA", "ACGTACGTACGTA", 1.0), ("r3", "TTTTTTTTTTTTTTT", "TTTTTTTTTTTTTTT", 1.0)]
    got = M.cluster_rows(spark.createDataFrame(d, "read_id string, seq string, representative string, identity double"))
    assert rows(got.select("cluster_no", "idx", "len", "read_id")) == [(0, 0, 15, "r3"), (1, 0, 13, "r1"), (1, 1, 13, "r2"), (1, 2, 12, "r0")]
    lines = [r["line"] for r in sinks.cluster_lines(got).orderBy("cluster_no", "idx").collect()]
    assert lines[0] == "Cluster_0\t0\t15nt\tr3\t*" and lines[3] == "Cluster_1\t2\t12nt\tr0\tat 99.00%"


def test_last_cluster_of_a_read_holds(spark, tmp_path):
    (tmp_path / "u.clstr").write_text("Cluster_9\t0\t24nt\tr1\t*\nCluster_0\t1\t24nt\tr1\tat 98.00%\nCluster_5\t0\t24nt\tr2\t*\n")
    assert rows(files.clusters(spark, str(tmp_path / "u.clstr"))) == [("r1", "Cluster_0"), ("r2", "Cluster_5")]


def test_candidates_without_cluster_and_their_tables(spark):
    c = spark.createDataFrame([("a", "c1", "i1"), ("b", "c1", "i2"), ("z", "c1", "i1")], "read_id string, circ_id string, isoform_id string")
    d = M.with_clusters(c, spark.createDataFrame([("a", "u1"), ("b", "u2")], "read_id string, cluster_id string"))
    assert rows(d.select("read_id", "cluster_id")) == [("a", "u1"), ("b", "u2"), ("z", "")]
    iso, circ = M.candidate_tables(M.vote_clusters(d))
    assert iso.isEmpty() and rows(circ) == [("c1", 2)]


def test_n50(spark):
    one = lambda *n: tuple(M.n50(spark.createDataFrame([("A" * x,) for x in n], "seq string")).first())
    assert one(2, 2, 2, 3, 3, 4, 8, 8) == (8, 32, 8) and one(10) == (1, 10, 10)
    assert tuple(M.n50(spark.createDataFrame([], "seq string")).first()) == (0, 0, None)


def test_samples_of_molecules(spark):
    d = spark.createDataFrame([(f"r{i}", 10, f"c{i % 4}", f"u{i % 6}") for i in range(24)] + [("x", 10, "c9", None)], "read_id string, len long, circ_id string, umi string")
    got = M.saturation(d, (6,), 2, "umi").collect()
    assert len(got) == 2 and all((r["total_len"], r["n_circ"]) == (240, 4) for r in got)


def test_words_that_skip_letters(spark):
    d = spark.createDataFrame([(1, "AANCCGT"), (2, "NN"), (3, "")], "id int, seq string")
    assert rows(M.skipping_kmers(d, 3)) == [(1, 3, "AAC"), (1, 4, "ACC"), (1, 5, "CCG"), (1, 6, "CGT")]
    assert rows(M.skipping_kmers(d, 3, True)) == [(1, 5, "ACG"), (1, 6, "CGT")]


def test_peaks():
    assert K.merged_peak([100, 100, 101, 99, 300]) == 100 and K.merged_peak([7]) == 7 and abs(K.silverman(4) - 3**-0.2) < 1e-12


def test_lines_and_distances(spark):
    x = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 5), (8, 9))))
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.circle_line(F.lit("q"), F.lit("c"), F.lit("+"), F.lit(1), F.lit(9), x)) == "q\tc\t+\t1\t9\t1,8\t5,9\t7\tc:1-9:+\tc:1-9:+|1-5,8-9"
    assert one(S.alignment_line(F.lit("q"), F.lit("c"), F.lit("-"), x, F.lit(5), F.lit(0), F.lit(7), F.lit("AG"), F.lit(None).cast("string"))) == "q\tc\t1\t9\t0\t7\t1,8\t5,9\t5\t-\tAG\t"
    assert [one(S.bounded_distance(F.lit("ACGTA"), F.lit(b))) for b in ("ACGTA", "ACGTC", "CCCCC", "TTTTT")] == [0, 1, 3, 3]
    assert one(S.reverse_quality(F.lit("I#!"))) == "!#I"
    assert one(S.cigar_text(F.array(F.struct(F.lit(5).alias("n"), F.lit("M").alias("op")), F.struct(F.lit(2).alias("n"), F.lit("I").alias("op"))))) == "5M2I"


def test_annotation_of_unknown_strand_snaps_both(spark):
    e = spark.createDataFrame([("c", "G", ".", 100, 200), ("c", "H", "-", 103, 203)], "chr string, gene_id string, strand string, start_pos long, end_pos long")
    d = spark.createDataFrame([("p", "c", "+", 105, 205), ("m", "c", "-", 105, 205), ("u", "c", ".", 105, 205)], "query_id string, chr string, strand string, start_pos long, end_pos long")
    got = {r["query_id"]: (r["gene_id"], r["snap_start"]) for r in J.snap_to_genes(d, e).collect()}
    assert got == {"p": ("G", 100), "m": ("H", 103), "u": ("G", 100)}


def test_consensus_of_molecules(spark):
    a = "ACGTTGCAACGGTTACCAGTGTCA"
    ccs = spark.createDataFrame([("r1", "0-24;24-48", a * 2), ("r2", "0-24", a), ("r3", "0-24", a)], "read_id string, segments string, raw string")
    assert rows(molecule_consensus(ccs, spark.createDataFrame([("r1", "u"), ("r2", "u"), ("r3", "")], "read_id string, cluster_id string"))) == [("u", a)]


def test_fusion_of_one_chromosome_by_turns(spark):
    """All rows overlap the longest one: they take turns; the locus that starts first is the left one."""
    e = "array<struct<start:long,end:long>>"
    d = [("q", "c", "+", s, s + 200, 10 * k, 10 * k + 9, [(s, s + 200)], 200) for k, s in enumerate((500, 400, 500, 400))]
    aln = spark.createDataFrame(d, f"query_id string, chr string, strand string, ref_start long, ref_end long, query_start long, query_end long, exons {e}, exon_len long")
    gtf = spark.createDataFrame([("c", "G", "N", "+", 405, 605)], "chr string, gene_id string, gene_name string, strand string, start_pos long, end_pos long")
    loci = I.fusion_structure(aln, gtf)
    assert [(r["locus"], [tuple(x) for x in r["exons"]]) for r in loci.orderBy("locus").collect()] == [(1, [(400, 600)]), (2, [(500, 700)])]
    (t,) = I.fusion_table(loci, gtf, lambda d, at, name: d.withColumn(name, F.lit("NN"))).collect()
    assert (t["circID"], t["geneName_first"], t["geneName_second"], t["readCount"], len(t)) == ("c:400-600:+|c:500-700:+", "N", "intergenic", 1, 26)
