"""Operators against brute force, known answers and each other's invariants."""

import random

from pyspark.sql import functions as F

from ringloom.functions import sequence as S
from ringloom.operators import junctions as J
from ringloom.operators import molecules as M
from ringloom.operators import relational as rel
from ringloom.plans.calling import from_alignments
from ringloom.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_band_join(spark):
    rnd = random.Random(2)
    a = [(i, "c1", rnd.randrange(500)) for i in range(80)]
    b = [(i, "c1", rnd.randrange(500)) for i in range(80)]
    got = rel.band_join(spark.createDataFrame(a, "x int, k string, p int"), spark.createDataFrame(b, "y int, k string, q int"), ["k"], "p", "q", 14)
    assert rows(got.select("x", "y")) == sorted((i, j) for i, _, p in a for j, _, q in b if abs(p - q) <= 14)


def test_islands_are_disjoint(spark):
    d = spark.createDataFrame([("c", 1, 10), ("c", 5, 20), ("c", 21, 30), ("c", 100, 120), ("c", 70000, 70010), ("c", 69990, 70005)], "chr string, s long, e long")
    assert rows(rel.islands(d, "chr", "s", "e")) == [("c", 1, 20, 2), ("c", 21, 30, 1), ("c", 100, 120, 1), ("c", 69990, 70010, 2)]


def test_interval_union_touching(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 35, 38)], "id int, s int, e int")
    assert rows(rel.interval_union(d, ["id"], "s", "e")) == [(1, 0, 20), (1, 30, 40)]


def test_samples_are_exact(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    got = rel.samples(d, "k", (10, 100), 2)
    assert rows(got.groupBy("sample_size", "rep").agg(F.countDistinct("k"))) == [(10, 0, 10), (10, 1, 10), (100, 0, 100), (100, 1, 100)]
    assert rows(got) == rows(rel.samples(d.repartition(7), "k", (10, 100), 2))


def test_absorb(spark):
    d = [("c", "+", 100, 300)] * 5 + [("c", "+", 110, 310)] * 2 + [("c", "-", 110, 310)] + [("c", "+", 900, 999)]
    got = J.absorb_sites(spark.createDataFrame(d, "chr string, strand string, start_pos long, end_pos long"))
    assert rows(got) == [("c", "+", 100, 300, 5, 100, 300), ("c", "+", 110, 310, 2, 100, 300), ("c", "+", 900, 999, 1, 900, 999), ("c", "-", 110, 310, 1, 110, 310)]


def test_cigar_and_fetch(spark):
    d = spark.createDataFrame([("5S10M100N20M3I4D6M2H", 50)], "c string, b int").select(S.cigar_blocks(F.col("c"), F.col("b")).alias("x"))
    x = d.first()["x"]
    assert [(e["start"], e["end"]) for e in x["exons"]] == [(50, 60), (160, 190)] and (x["query_start"], x["query_end"]) == (5, 44)
    f = lambda s, a, b: spark.range(1).select(S.fetched(F.lit(s), F.lit(a), F.lit(b))).first()[0]
    assert f("ACGT", 1, 3) == "CG" and f("ACGT", 1, 9) == "NA" and f(None, 1, 3) == ""


def test_revcomp_twice(spark):
    s = "ACGTNACCA"
    assert spark.range(1).select(S.revcomp(S.revcomp(F.lit(s)))).first()[0] == s


def test_exon_tokens(spark):
    ref = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((100, 200), (300, 400), (500, 600))))
    t = lambda a, b, st: spark.range(1).select(S.exon_token(F.lit(a), F.lit(b), ref, F.lit(st))).first()[0]
    assert t(300, 400, "+") == "2" and t(300, 430, "+") == "L2" and t(330, 400, "+") == "2S"
    assert t(500, 600, "-") == "1" and t(201, 299, "+") == "RI" and t(5000, 5100, "+") == "NE"


def test_umi_clusters(spark):
    a, b = "ACGTTGCAACGGTTACCAGTGTCA", "TTGACCGATACGGATTCAGCCTGA"
    d = spark.createDataFrame([("1", a), ("2", a), ("3", a[:-1]), ("4", b), ("5", "ACGT")], "read_id string, seq string")
    got = {r[0]: r[1] for r in M.cluster_umis(d).collect()}
    assert got == {"1": a, "2": a, "3": a, "4": b}


def test_vote_counts_a_molecule_once(spark):
    d = spark.createDataFrame([("u1", "c1", "i1")] * 5 + [("u2", "c1", "i1"), ("u3", "c1", "i2"), ("", "c9", "i9"), ("u4", "c2", "i3")], "cluster_id string, circ_id string, isoform_id string")
    assert rows(M.vote_clusters(d)) == [("c1", "i1", 2, 3, True), ("c1", "i2", 1, 3, False)]


def test_readers(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert rows(files.fastq(spark, str(tmp_path / "r.fastq"))) == [("r1", "ACGT", "IIII"), ("r2", "AC", "II")]
    (tmp_path / "g.fa").write_text(">c1 d\nACGT\nAC\n>c2\nTT\n")
    g = files.genome(spark, str(tmp_path / "g.fa"))
    assert rows(g) == [("c1", "ACGTAC"), ("c2", "TT")]
    assert rows(files.genome_blocks(g, 4, 1)) == [("c1", 0, 0, "ACGTA"), ("c1", 1, 4, "AC"), ("c2", 0, 0, "TT")]
    (tmp_path / "a.gtf").write_text('#x\nc1\ts\texon\t5\t9\t.\t+\t.\tgene_id "g"; transcript_id "t";\n')
    assert rows(files.gtf(spark, str(tmp_path / "a.gtf"))) == [("exon", "c1", "g", "t", "", "+", 5, 9)]
    (tmp_path / "a.sam").write_text("@HD\nq\t0\tc1\t11\t60\t4M\t*\t0\t0\tACGT\tIIII\nq\t256\tc1\t11\t60\t4M\t*\t0\t0\t*\t*\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert rows(files.mapped_rows(files.sam(spark, str(tmp_path / "a.sam")))) == [("q", 0, "c1", 10, 60, "4M", "ACGT")]
    (tmp_path / "u.clstr").write_text("Cluster_0\t0\t24nt\tr1\t*\nCluster_0\t1\t24nt\tr2\tat 98.00%\n")
    assert rows(files.clusters(spark, str(tmp_path / "u.clstr"))) == [("r1", "Cluster_0"), ("r2", "Cluster_0")]


def test_bam(spark, tmp_path):
    import gzip
    import struct

    rec = struct.pack("<iiBBHHHiiii", 0, 7, 3, 60, 0, 1, 16, 4, -1, -1, 0) + b"q1\0" + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + b"\xff" * 4
    body = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100) + struct.pack("<i", len(rec)) + rec
    (tmp_path / "x.bam").write_bytes(gzip.compress(body))
    assert rows(files.bam(spark, str(tmp_path / "x.bam"))) == [("q1", 16, "c1", 7, 60, "4M", "ACGT")]


def test_fasta_lines(spark):
    d = spark.createDataFrame([("a", "A" * 170), ("b", "C" * 80)], "read_id string, seq string")
    assert [r["line"] for r in sinks.fasta(d).orderBy("read_id").collect()] == [">a\n" + "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 10, ">b\n" + "C" * 80]


def micro(spark):
    """One contig, a gene of three exons on +, reads of a circle over exons 2 and 3."""
    rnd = random.Random(9)
    seq = [rnd.choice("ACGT") for _ in range(4000)]
    seq[1197:1199], seq[2000:2002] = "AG", "GT"  # flanks of 1200..2000
    contigs = spark.createDataFrame([("c1", "".join(seq))], "chr string, seq string")
    ex = [("exon", "c1", "G1", "T1", "name", "+", a, b) for a, b in ((500, 600), (1200, 1300), (1900, 2000))]
    gtf = spark.createDataFrame(ex, "feature string, chr string, gene_id string, transcript_id string, gene_name string, strand string, start_pos long, end_pos long")
    aln, hyp = [], []
    for i, off in enumerate((0, 3, -5, 0)):
        for k in range(2):  # two passes over the circle
            aln.append((f"q{i}", 0, "c1", 1199, f"{k * 200}S101M599N101M"))
        hyp.append((f"q{i}", "c1", "+", 1200 + off, 2000 + off))
    aln += [("one", 0, "c1", 1199, "50M"), ("un", 4, "*", 0, "*")]
    return spark.createDataFrame(aln, "query_id string, flag int, chr string, ref_begin long, cigar string"), spark.createDataFrame(hyp, "query_id string, chr string, strand string, start_pos long, end_pos long"), gtf, contigs


def test_calling(spark):
    a, h, g, c = micro(spark)
    got = from_alignments(a, g, c, hypotheses=h)
    assert {r["read_type"] for r in got["types"].collect()} == {"sameChrCandidate"}
    (c,) = got["circles"].collect()
    assert (c["start_pos"], c["end_pos"], c["n_reads"], c["circ_type"], c["host_gene"], c["best_transcript"]) == (1200, 2000, 4, "exon", "G1", "T1")
    assert c["final_name"] == "circname(2,3).1" and c["len"] == 202
    lines = [r["line"].split("\t")[2] for r in got["lines"].orderBy("circ_id", "transcript", "ord").collect()]
    assert lines == ["BSJ", "transcript", "exon", "exon"]


def test_calling_is_permutation_invariant(spark):
    a, h, g, c = micro(spark)
    x = from_alignments(a, g, c, hypotheses=h)["circles"]
    y = from_alignments(a.repartition(5, "cigar"), g.repartition(3), c, hypotheses=h.orderBy(F.rand(3)))["circles"]
    assert rows(x.select(*sorted(x.columns)).drop("exons")) == rows(y.select(*sorted(x.columns)).drop("exons"))


def test_calling_from_reads_alone(spark):
    """Circles on both strands, found by mapping reads over the seam; a linear read is none."""
    rnd = random.Random(12)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    seq = list(dna(9000))
    for at, text in ((1197, "AG"), (2000, "GT"), (1300, "GT"), (1897, "AG"), (5197, "AC"), (6000, "CT"), (5300, "CT"), (5897, "AC")):
        seq[at : at + 2] = text
    seq = "".join(seq)
    contigs = spark.createDataFrame([("c1", seq)], "chr string, seq string")
    ex = [("exon", "c1", g, t, "", st, a, b) for g, t, st, o in (("G1", "T1", "+", 0), ("G2", "T2", "-", 4000)) for a, b in ((500 + o, 600 + o), (1200 + o, 1300 + o), (1900 + o, 2000 + o))]
    gtf = spark.createDataFrame(ex, "feature string, chr string, gene_id string, transcript_id string, gene_name string, strand string, start_pos long, end_pos long")
    back = str.maketrans("ACGT", "TGCA")
    aln, reads = [], []
    for i, (o, st) in enumerate(((0, "+"), (0, "+"), (4000, "-"), (4000, "-"))):
        once = seq[1199 + o : 1300 + o] + seq[1899 + o : 2000 + o]
        turn = 20 + 11 * i
        read = (once * 4)[turn : turn + 520]
        reads.append((f"q{i}", read if st == "+" else read.translate(back)[::-1]))
        for k in range(2):
            aln.append((f"q{i}", 0 if st == "+" else 16, "c1", 1199 + o, f"{k * 210}S101M599N101M"))
    reads.append(("linear", seq[3000:3400]))
    aln += [("linear", 0, "c1", 3000, "200M200S"), ("linear", 0, "c1", 3200, "200S200M")]
    got = from_alignments(spark.createDataFrame(aln, "query_id string, flag int, chr string, ref_begin long, cigar string"), gtf, contigs, spark.createDataFrame(reads, "read_id string, seq string"))
    assert {r["query_id"]: r["read_type"] for r in got["types"].collect()} == {f"q{i}": "sameChrCandidate" for i in range(4)} | {"linear": "sameChrNotCandidate"}
    circles = rows(got["circles"].select("strand", "start_pos", "end_pos", "n_reads", "host_gene", "final_name"))
    assert circles == [("+", 1200, 2000, 2, "G1", "circG1(2,3).1"), ("-", 5200, 6000, 2, "G2", "circG2(1,2).1")]


def test_spliced_blocks_end_at_the_motif():
    from ringloom.operators.kernels import seam_junctions, spliced_chains

    rnd = random.Random(2)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    a, b, left, right = dna(80), dna(90), dna(40), dna(30)
    target = left + a + "GT" + dna(300) + "AG" + b + right
    assert spliced_chains(a + b, target) == [[(40, 120), (424, 514)]]
    assert spliced_chains(dna(100), target) == []
    # a region of 500 and 300 on both sides, twice: blocks to the first end and from the second start
    assert seam_junctions([(300, 400), (700, 800), (1400, 1500), (1800, 1900)], 500) == [(0, 500)]
    assert seam_junctions([(300, 400)], 500) == []


def test_rare_isoforms_move_and_bounds_are_absorbed(spark):
    from ringloom.operators import isoforms as I

    schema = "query_id string, chr string, strand string, start_pos long, end_pos long, exons array<struct<start:long,end:long>>"
    iso = lambda q, *e: (q, "c", "+", 100, 900, list(e))
    d = [iso(f"h{i}", (100, 200), (700, 900)) for i in range(3)] + [iso("a", (100, 213), (690, 900)), iso("b", (100, 214), (700, 900)), iso("c", (100, 900))]
    got = {r["query_id"]: [tuple(x) for x in r["exons"]] for r in I.to_confident(spark.createDataFrame(d, schema)).collect()}
    assert got["a"] == [(100, 200), (700, 900)] and got["b"] == [(100, 214), (700, 900)] and got["c"] == [(100, 900)]
    rnd = random.Random(5)
    d = [(f"q{i}", "c", "+", 100, 900, [(100 + rnd.randrange(12), 200 + rnd.randrange(60)), (600 + rnd.randrange(60), 900)]) for i in range(150)]
    got = {r["query_id"]: [tuple(x) for x in r["exons"]] for r in I.absorb_bounds(spark.createDataFrame(d, schema)).collect()}
    for side in (0, 1):
        count = {}
        for r in d:
            for x in r[5]:
                count[x[side], 0] = count.get((x[side], 0), 0) + 1
        to = plain_absorption(count, 14)
        assert all(got[r[0]][j][side] == to[r[5][j][side], 0][0] for r in d for j in (0, 1))
    assert I.absorb_bounds(spark.createDataFrame([], schema)).isEmpty() and I.to_confident(spark.createDataFrame([], schema)).isEmpty()


def test_candidate_rows(spark):
    from ringloom.operators import isoforms as I

    e = "array<struct<start:long,end:long>>"
    rec = lambda q, n, s, *x: (q, n, "c", "+", s, x[-1][1], 10 * n, 10 * n + 9, list(x), sum(b - a for a, b in x))
    d = [rec("two", 1, 100, (100, 200), (300, 400)), rec("two", 2, 450, (390, 500)), rec("near", 1, 100, (100, 200)), rec("near", 2, 120, (120, 200)), rec("again", 1, 5, (5, 9)), rec("again", 2, 5, (5, 10))]
    recs = spark.createDataFrame(d, f"query_id string, aln long, chr string, strand string, ref_start long, ref_end long, query_start long, query_end long, exons {e}, exon_len long")
    types = spark.createDataFrame([(q, "sameChrCandidate") for q in ("two", "near", "again")], "query_id string, read_type string")
    got = sorted((r["query_id"], r["ref_start"], r["ref_end"], [tuple(x) for x in r["exons"]], r["exon_len"]) for r in I.candidate_rows(recs, types, spark.createDataFrame([("again", 2)], "query_id string, aln long")).collect())
    assert got == [("again", 5, 10, [(5, 10)], 5), ("near", 100, 200, [(100, 200)], 100), ("near", 120, 200, [(120, 200)], 80), ("two", 100, 500, [(100, 200), (300, 500)], 300)]


def test_empty_in_empty_out(spark):
    sites = spark.createDataFrame([], "query_id string, chr string, strand string, start_pos long, end_pos long, left_ok boolean, right_ok boolean")
    assert J.cluster_junctions(sites).isEmpty() and J.absorb_sites(sites).isEmpty()
    assert rel.islands(sites, "chr", "start_pos", "end_pos").isEmpty()


def test_stream_of_batches(spark, tmp_path):
    from ringloom.streaming import each_batch

    for i in range(2):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    each_batch(spark, str(tmp_path / "in"), "id long", lambda d: d.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def plain_absorption(sites, tol):
    """Every site looks at every other one."""
    left, to = dict(sites), {}
    for s in sorted(sites):
        if not left[s]:
            continue
        best, most = s, left[s]
        for t in sorted(sites):
            if abs(t[0] - s[0]) <= tol and abs(t[1] - s[1]) <= tol and left[t] >= most:
                best, most = t, left[t]
        if best != s:
            left[best] += left[s]
            left[s] = 0
            to[s] = best
    return {s: to.get(s, s) for s in sites}


def test_absorb_brute_force(spark):
    rnd = random.Random(4)
    rows_ = [("c1", st, 30 * rnd.randrange(60) + rnd.randrange(3), 0) for st in "+-" for _ in range(300)] + [("c1", "+", 200_000 + rnd.randrange(90), 0) for _ in range(50)]
    rows_ = [(c, st, s, s + 200 + 7 * rnd.randrange(6), f"L{s}") for c, st, s, _ in rows_]
    got = J.absorb_sites(spark.createDataFrame([(*r, r[4]) for r in rows_], "chr string, strand string, start_pos long, end_pos long, left_seq string, right_seq string")).collect()
    for st in "+-":
        count = {}
        for _, x, s, e, _ in rows_:
            if x == st:
                count[s, e] = count.get((s, e), 0) + 1
        want = plain_absorption(count, 40)
        assert {(r["start_pos"], r["end_pos"]): (r["to_start"], r["to_end"]) for r in got if r["strand"] == st} == want
    assert all(r["to_left_seq"] == f"L{r['to_start']}" for r in got)


def test_consensus_of_a_hot_key_weighs_its_groups(spark):
    from ringloom.operators import kernels as K

    a, b = "ACGTTGCAACGGTTACCAGTGTCA", "ACGTTGCAACGCTTACCAGTGTCA"
    d = spark.createDataFrame([("k", i, a) for i in range(200)] + [("k", 200, b)] + [("m", 0, b)], "key string, ord long, seq string")
    assert rows(K.consensus_by(d, "key")) == [("k", a), ("m", b)]
    rnd = random.Random(3)
    many = [("k", i, "".join(rnd.choice("ACGT") if rnd.random() < 0.03 else c for c in a)) for i in range(60)]
    assert rows(K.consensus_by(spark.createDataFrame(many, "key string, ord long, seq string"), "key", 8)) == [("k", a)]
