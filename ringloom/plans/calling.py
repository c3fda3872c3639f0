"""From alignments to named circles. Results that several later steps read are
checkpointed once; everything between is one lazy plan.

Options are frozen; each stage is a function of DataFrames and may be used alone.
The genome aligner itself is an external step: the plan starts from its SAM or BAM
rows (``from_alignments``), or from reads for the UMI and tandem stages before it.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringloom.functions import sequence as S
from ringloom.operators import annotate, isoforms, junctions, kernels, molecules
from ringloom.operators import reads as reads_op
from ringloom.operators.storage import materialised
from ringloom.sources import files, sinks


@dataclass(frozen=True)
class CallOptions:
    threshold: int = 2
    snap: int = junctions.SNAP
    hang: int = junctions.HANG
    exon_tol: int = junctions.EXON_TOL


def alignment_records(aln: DataFrame) -> DataFrame:
    """SAM rows as exon-block alignments with query positions."""
    d = files.mapped_rows(aln).where("cigar <> '*'").withColumn("b", S.cigar_blocks(F.col("cigar"), F.col("ref_begin")))
    strand = F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-")
    d = d.select("query_id", "chr", strand.alias("strand"), F.col("ref_begin").alias("ref_start"), F.element_at("b.exons", -1)["end"].alias("ref_end"), "b.query_start", "b.query_end", F.col("b.exons").alias("exons"))
    return d.withColumn("exon_len", F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"]))


def fetched(d: DataFrame, start0, contigs: DataFrame, name: str, size: int = 1 << 20) -> DataFrame:
    """Adds the two bases from a 0-based position on, from genome blocks: '' without a contig, NA off its ends."""
    blocks = files.genome_blocks(contigs, size).withColumnsRenamed({"seq": "_seq", "block": "_block", "block_start": "_from"})
    d = d.withColumn("_at", start0.cast("long")).withColumn("_block", F.floor(F.greatest(F.col("_at"), F.lit(0)) / size).cast("int"))
    d = d.join(blocks, ["chr", "_block"], "left")
    known = contigs.select("chr").distinct().withColumn("_known", F.lit(True))
    d = d.join(known, "chr", "left")
    got = F.when(F.col("_seq").isNull() | (F.col("_at") < 0), "").otherwise(F.substring("_seq", (F.col("_at") - F.col("_from") + 1).cast("int"), F.lit(2)))
    return d.withColumn(name, F.when(F.col("_known").isNull(), "").when(F.length(got) < 2, "NA").otherwise(got)).drop("_at", "_block", "_from", "_seq", "_known")


def flanks(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds left_seq and right_seq, the dinucleotides next to a site."""
    return fetched(fetched(sites, F.col("start_pos") - 3, contigs, "left_seq"), F.col("end_pos"), contigs, "right_seq")


def molecule_consensus(ccs: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, seq: the consensus of all segments of all reads (read_id, segments, raw) of each molecule
    (read_id, cluster_id); reads outside clusters go."""
    d = ccs.join(clusters.select("read_id", "cluster_id").where("cluster_id <> ''"), "read_id")
    d = d.select("cluster_id", "read_id", F.posexplode(S.segments_of(F.col("segments"), F.col("raw"))).alias("i", "seq"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("read_id", "i"))
    return kernels.consensus_by(d.withColumn("ord", place), "cluster_id")


def regions(rows: DataFrame, key: list[str], contigs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """key, seq: the joined sequence of the regions (key, ord, chr, start0, end0) of each key, fetched from
    genome blocks; keys with a region outside its contig are left out."""
    size = F.col("end0") - F.col("start0")
    want = rows.where("start0 >= 0 and end0 > start0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start0") / block).cast("int"), F.floor((F.col("end0") - 1) / block).cast("int"))))
    blocks = files.genome_blocks(contigs, block, 0)
    got = want.join(blocks, ["chr", "block"])
    lo, hi = F.greatest("start0", "block_start"), F.least("end0", F.col("block_start") + block)
    part = F.substring("seq", (lo - F.col("block_start") + 1).cast("int"), (hi - lo).cast("int"))
    whole = got.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block", part.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    need = rows.groupBy(*key).agg(F.sum(size).alias("_n"))
    return whole.join(need, key).where(F.length("seq") == F.col("_n")).drop("_n")


def repeated_rows(recs: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(query_id, aln) of alignments to whose own spliced reference the read maps repeatedly, among reads of several rows."""
    several = recs.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id")
    d = recs.join(several, "query_id", "left_semi").select("query_id", "aln", "chr", F.posexplode("exons").alias("ord", "x"))
    d = d.select("query_id", "aln", "chr", "ord", F.col("x.start").alias("start0"), F.col("x.end").alias("end0"))
    ref = regions(d, ["query_id", "aln"], contigs).withColumnRenamed("seq", "ref")
    pairs = ref.join(reads.select(F.col("read_id").alias("query_id"), "seq"), "query_id").withColumn("query_id", F.concat_ws("\t", F.col("aln").cast("string"), "query_id"))
    flags = kernels.remap_flags(pairs).where("remapped")
    at = F.split("query_id", "\t", 2)
    return flags.select(F.get(at, F.lit(1)).alias("query_id"), F.get(at, F.lit(0)).cast("long").alias("aln"))


def proposed(cands: DataFrame, reads: DataFrame, contigs: DataFrame, hang: int) -> DataFrame:
    """Back-splices proposed for each read by its longest candidate row."""
    top = reads_op.top_alignment(cands)
    window = top.select("query_id", F.lit(0).alias("ord"), "chr", (F.col("ref_start") - hang).alias("start0"), (F.col("ref_end") + hang).alias("end0"))
    window = regions(window, ["query_id"], contigs).withColumnRenamed("seq", "window")
    d = top.select("query_id", "chr", "ref_start").join(window, "query_id").join(reads.select(F.col("read_id").alias("query_id"), "seq"), "query_id")
    return kernels.junction_hypotheses(d, hang)


def isoform_rows(recs: DataFrame, sites: DataFrame, gtf: DataFrame, opt: CallOptions) -> DataFrame:
    """One row per read: query_id, chr, strand, start_pos, end_pos, exons (1-based), snapped, rare
    isoforms moved to frequent ones, and exon bounds absorbed within each circle."""
    d = recs.select("query_id", "chr", "ref_start", "ref_end", "exon_len", F.size("exons").cast("long").alias("n_exons"), F.posexplode("exons").alias("exon_no", "x"))
    d = d.select("query_id", "chr", "ref_start", "ref_end", "exon_len", "n_exons", F.col("exon_no").cast("long").alias("exon_no"), F.col("x.start").alias("exon_start"), F.col("x.end").alias("exon_end"))
    iso = reads_op.isoforms(d, sites, opt.hang)
    e = F.struct(F.col("exon_start").alias("start"), F.col("exon_end").alias("end"))
    iso = iso.groupBy("query_id", "chr", "strand").agg(F.array_sort(F.collect_list(e)).alias("exons"))
    iso = iso.join(sites.select("query_id", "start_pos", "end_pos"), "query_id")
    # the bounds of the circle hold, whatever its first and last exon's own were
    iso = materialised(isoforms.snapped(iso, ["query_id"], gtf, opt.exon_tol))
    moved = materialised(isoforms.to_confident(iso, opt.exon_tol))
    return isoforms.absorb_bounds(moved, opt.exon_tol)


def from_alignments(aln: DataFrame, gtf: DataFrame, contigs: DataFrame, reads: DataFrame | None = None, hypotheses: DataFrame | None = None, opt: CallOptions = CallOptions()) -> dict[str, DataFrame]:
    """types, sites, circles, fusions, lines, and what lies between: candidates, hypotheses, isoforms, loci.

    reads (read_id, seq): the sequences that were aligned; they are mapped again to tell circles from
    other repeats, and over the seam of their longest alignment to propose back-splices. hypotheses (query_id, chr,
    strand, start_pos, end_pos) may propose them instead, or besides; without both nothing is found."""
    recs = alignment_records(aln)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("query_start", "query_end", "ref_start", "ref_end", "chr", "strand"))
    recs = materialised(recs.withColumn("aln", order.cast("long")))
    again = None if reads is None else materialised(repeated_rows(recs, reads, contigs))
    if again is None:
        types = reads_op.read_types(recs)
    else:
        mark = again.select("query_id").distinct().withColumn("again", F.lit(True))
        types = reads_op.read_types(recs.join(mark, "query_id", "left"), F.coalesce(F.max("again"), F.lit(False)))
    types = materialised(types)
    cands = materialised(isoforms.candidate_rows(recs, types, again, opt.hang))
    exons = gtf.where("feature = 'exon'")
    hyp = [] if reads is None else [proposed(cands, reads, contigs, opt.hang)]
    if hypotheses is not None:
        hyp.append(hypotheses.select("query_id", "chr", "strand", "start_pos", "end_pos").join(cands.select("query_id"), "query_id", "left_semi"))
    if not hyp:
        raise ValueError("from_alignments needs reads or hypotheses")
    hyp = materialised(reduce(DataFrame.unionByName, hyp).where("start_pos <= end_pos"))
    snapped = junctions.snap_to_genes(hyp, gtf, opt.snap)
    by = ["query_id", "chr", "strand", "start_pos", "end_pos"]
    moved = hyp.join(snapped.select(*by, "snap_start", "snap_end"), by, "left").select("query_id", "chr", "strand", F.coalesce("snap_start", "start_pos").alias("start_pos"), F.coalesce("snap_end", "end_pos").alias("end_pos"))
    voted = junctions.vote_junction(flanks(moved, contigs), junctions.motif_rows(aln.sparkSession))
    sites = junctions.cluster_junctions(voted.select("query_id", "chr", "strand", "start_pos", "end_pos", "left_ok", "right_ok", "left_seq", "right_seq"), opt.snap)
    sites = materialised(sites.select("query_id", "chr", "strand", F.col("site_start").alias("start_pos"), F.col("site_end").alias("end_pos")))
    iso = isoform_rows(cands, sites, gtf, opt)
    tid = F.concat(S.circ_id(F.col("chr"), F.col("start_pos"), F.col("end_pos"), F.col("strand")), F.lit("|"), S.exon_text(F.col("exons")))
    iso = materialised(iso.withColumn("circ_key", tid))
    kept = iso.groupBy("circ_key", "chr", "strand", "start_pos", "end_pos", "exons").agg(F.count("*").alias("n_reads")).where(F.col("n_reads") >= opt.threshold)
    kept = materialised(kept)
    parts = kept.select("circ_key", F.explode("exons").alias("x")).select("circ_key", F.col("x.start").alias("c_start"), F.col("x.end").alias("c_end"))
    noted = annotate.annotate(kept, parts, exons)
    tx = annotate.transcripts(exons).select(F.col("transcript_id").alias("best_transcript"), F.col("exons").alias("ref"), F.col("gene_id").alias("host_gene"))
    names = gtf.where("gene_name <> ''").groupBy(F.col("gene_id").alias("host_gene")).agg(F.min("gene_name").alias("host_gene_name"))
    circles = kept.join(noted, "circ_key").join(tx, ["host_gene", "best_transcript"], "left").join(names, "host_gene", "left")
    circles = circles.withColumn("uniform_id", S.uniform_id(F.coalesce("host_gene_name", "host_gene"), S.circ_id(F.col("chr"), F.col("start_pos"), F.col("end_pos"), F.col("strand")), F.col("exons"), F.coalesce("ref", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.col("strand")))
    circles = annotate.ranked_names(circles, "uniform_id").drop("ref").withColumn("len", S.exon_length(F.col("exons")))
    fused = recs.join(types.where("read_type in ('twoChrsFusion', 'sameChrFusion')").select("query_id"), "query_id", "left_semi")
    loci = materialised(isoforms.fusion_structure(fused, gtf, opt.exon_tol))
    fusions = isoforms.fusion_table(loci, gtf, lambda d, at, name: fetched(d, F.col(at), contigs, name), opt.exon_tol)
    return {"types": types, "sites": sites, "circles": circles, "fusions": fusions, "lines": sinks.gtf_lines(iso, opt.threshold), "candidates": cands, "hypotheses": hyp, "isoforms": iso, "loci": loci}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ringloom", description="Circular transcripts from long reads on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract-umi", help="strand and UMI of reads")
    x.add_argument("fastq"), x.add_argument("out"), x.add_argument("--anchor", required=True), x.add_argument("--pattern", default=kernels.PATTERN)
    x = sub.add_parser("cluster-umi", help="cluster UMIs of a FASTA file")
    x.add_argument("fasta"), x.add_argument("out")
    x = sub.add_parser("ccs", help="tandem-repeat consensus of reads")
    x.add_argument("fastq"), x.add_argument("out")
    x = sub.add_parser("cluster-reads", help="cluster whole reads of a FASTA file")
    x.add_argument("fasta"), x.add_argument("out")
    x = sub.add_parser("consensus", help="tripled consensus of each molecule, or of each read without clusters")
    x.add_argument("ccs"), x.add_argument("out"), x.add_argument("--clusters", help="cluster table of the reads' UMIs")
    x = sub.add_parser("call", help="circles from alignments")
    x.add_argument("alignments"), x.add_argument("gtf"), x.add_argument("genome"), x.add_argument("out"), x.add_argument("--threshold", type=int, default=2)
    x.add_argument("--debug", help="folder for the tables between the steps")
    x.add_argument("--reads", help="FASTQ or FASTA of the aligned reads"), x.add_argument("--hypotheses", help="table of proposed back-splices")
    x = sub.add_parser("saturation", help="circles found in samples of reads")
    x.add_argument("reads"), x.add_argument("out"), x.add_argument("--interval", type=int, default=1000), x.add_argument("--repeat", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("ringloom").getOrCreate()
    if a.command == "extract-umi":
        kernels.umi_reads(files.fastq(spark, a.fastq), a.anchor, a.pattern).write.parquet(a.out)
    elif a.command == "cluster-umi":
        molecules.cluster_umis(files.fasta(spark, a.fasta).withColumnRenamed("id", "read_id")).write.parquet(a.out)
    elif a.command == "cluster-reads":
        molecules.cluster_umis(files.fasta(spark, a.fasta).withColumnRenamed("id", "read_id"), 0.95, 10).write.parquet(a.out)
    elif a.command == "ccs":
        kernels.ccs_reads(files.fastq(spark, a.fastq)).write.parquet(a.out)
        found = spark.read.parquet(a.out)
        for name in ("ccs", "raw"):
            sinks.fasta(found.select("read_id", F.col(name).alias("seq"))).select("line").write.text(f"{a.out}.{name}.fa")
    elif a.command == "consensus":
        found = spark.read.parquet(a.ccs)
        if a.clusters:
            found = molecule_consensus(found, files.clusters(spark, a.clusters)).withColumnRenamed("cluster_id", "read_id")
        else:
            found = found.select("read_id", F.col("ccs").alias("seq"))
        sinks.fasta(sinks.tripled(found)).select("line").write.text(a.out)
    elif a.command == "call":
        aln = (files.bam if a.alignments.endswith(".bam") else files.sam)(spark, a.alignments)
        hyp = files.tsv(spark, a.hypotheses, "query_id string, chr string, strand string, start_pos long, end_pos long") if a.hypotheses else None
        seqs = None
        if a.reads:
            seqs = files.fastq(spark, a.reads) if a.reads.endswith(("fastq", "fq", "fastq.gz", "fq.gz")) else files.fasta(spark, a.reads).withColumnRenamed("id", "read_id")
        got = from_alignments(aln, files.gtf(spark, a.gtf), files.genome(spark, a.genome), seqs, hyp, CallOptions(a.threshold))
        got["circles"].write.parquet(f"{a.out}/circles")
        got["fusions"].orderBy("isoID").write.csv(f"{a.out}/fusions", sep="\t", header=True)
        for name in ("types", "candidates", "hypotheses", "sites", "isoforms", "loci") if a.debug else ():
            got[name].write.parquet(f"{a.debug}/{name}")
        sinks.write_sorted_text(got["lines"], ["circ_id", "transcript", "ord"], f"{a.out}/gtf")
    else:
        d = files.tsv(spark, a.reads, "read_id string, len long, circ_id string")
        sizes = range(a.interval, d.select("read_id").distinct().count(), a.interval)
        molecules.saturation(d, tuple(sizes) or (a.interval,), a.repeat).write.csv(a.out, sep="\t", header=True)


if __name__ == "__main__":
    main()
