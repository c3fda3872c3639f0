"""Rows of the output formats: GTF, FASTA, cluster tables, fusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.functions.sequence import circ_id, exon_text

SOURCE = "ringloom"


def gtf_lines(circ: DataFrame, least: int = 2) -> DataFrame:
    """circ_id, transcript, ord, line: a BSJ line, then a transcript line per isoform and its exons.

    circ: chr, strand, start_pos, end_pos, exons (array of start, end), a row per
    read. Isoforms of fewer than ``least`` reads go; a BSJ counts its isoforms' reads.
    Sorted by (circ_id, transcript, ord), the lines are the file."""
    d = circ.withColumn("circ_id", circ_id(F.col("chr"), F.col("start_pos"), F.col("end_pos"), F.col("strand"))).withColumn("transcript", F.concat("circ_id", F.lit("|"), exon_text(F.col("exons"))))
    key = ["circ_id", "chr", "strand", "start_pos", "end_pos"]
    iso = d.groupBy(*key, "transcript", "exons").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    site = iso.groupBy(*key).agg(F.sum("n").alias("n"))
    line = lambda kind, s, e, n, extra: F.concat_ws("\t", "chr", F.lit(SOURCE), F.lit(kind), s.cast("string"), e.cast("string"), n, "strand", F.lit("."), F.concat(F.lit('circ_id "'), "circ_id", F.lit('";'), *extra))
    tx = (F.lit(' transcript_id "'), F.col("transcript"), F.lit('";'))
    a = site.select("circ_id", F.lit("").alias("transcript"), F.lit(0).alias("ord"), line("BSJ", F.col("start_pos"), F.col("end_pos"), F.col("n").cast("string"), ()).alias("line"))
    b = iso.select("circ_id", "transcript", F.lit(1).alias("ord"), line("transcript", F.col("start_pos"), F.col("end_pos"), F.col("n").cast("string"), tx).alias("line"))
    c = iso.select("*", F.posexplode("exons").alias("i", "x")).select("circ_id", "transcript", (F.col("i") + 2).alias("ord"), line("exon", F.col("x.start"), F.col("x.end"), F.lit("."), (*tx, F.lit(" exon_number "), (F.col("i") + 1).cast("string"), F.lit(";"))).alias("line"))
    return a.union(b).union(c)


def write_sorted_text(lines: DataFrame, order: list[str], path: str) -> None:
    """Text files whose parts, in name order, are the sorted lines."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def fasta(seqs: DataFrame, width: int = 80) -> DataFrame:
    """FASTA records (read_id, seq) as text values, lines of ``width`` letters."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return seqs.select("read_id", F.concat(F.lit(">"), "read_id", F.lit("\n"), wrapped).alias("line"))


def fastq(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("line"))


def tripled(seqs: DataFrame) -> DataFrame:
    """Consensus sequences thrice in a row, so that any rotation of a circle maps."""
    return seqs.withColumn("seq", F.repeat("seq", 3))


def cluster_lines(members: DataFrame) -> DataFrame:
    """Cluster table lines; members: cluster_no, idx, len, read_id, identity (null: representative)."""
    rate = F.when(F.col("identity").isNull(), "*").otherwise(F.format_string("at %.2f%%", F.col("identity") * 100))
    return members.select("cluster_no", "idx", F.concat_ws("\t", F.concat(F.lit("Cluster_"), F.col("cluster_no").cast("string")), F.col("idx").cast("string"), F.concat(F.col("len").cast("string"), F.lit("nt")), "read_id", rate).alias("line"))
