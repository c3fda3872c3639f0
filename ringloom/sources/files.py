"""Readers of sequence, annotation and alignment files.

FASTQ and FASTA records are split by Spark's text reader with a record
separator, so files of any Hadoop file system are read in splits; GTF, SAM and tables are
lines. BAM is block-compressed binary: files are read whole by the binary
reader, one task a file, and should be cut into files of moderate size.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.sequence import first_token

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800
SAM_SCHEMA = "query_id string, flag int, chr string, ref_begin long, mapq int, cigar string, seq string"


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq, qual of four-line records. Records begin at a line feed and @;
    of candidates those whose third line begins with + are records, so a quality
    line that begins with @ is put back where it belongs."""
    raw = spark.read.text(path, lineSep="\n@").withColumnRenamed("value", "v").withColumn("v", F.regexp_replace("v", r"\A@", ""))
    lines = F.split(F.regexp_replace("v", "\r", ""), "\n")
    d = raw.select(lines.alias("l")).where(F.size("l") >= 3)
    # the separator may have cut a record before its quality line, which then follows as a record of its own
    return d.where(F.get("l", F.lit(2)).startswith("+")).select(first_token(F.get("l", F.lit(0))).alias("read_id"), F.get("l", F.lit(1)).alias("seq"), F.coalesce(F.get("l", F.lit(3)), F.lit("")).alias("qual")).where("length(qual) = length(seq)")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq; lines of a record are joined."""
    raw = spark.read.text(path, lineSep="\n>")
    parts = F.split(F.regexp_replace(F.regexp_replace("value", r"\A>", ""), "\r", ""), "\n", 2)
    d = raw.select(parts.alias("p")).where(F.length(F.trim(F.get("p", F.lit(0)))) > 0)
    return d.select(first_token(F.get("p", F.lit(0))).alias("id"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def genome(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path).withColumnRenamed("id", "chr")


def genome_blocks(contigs: DataFrame, block: int = 1 << 20, overlap: int = 4096) -> DataFrame:
    """chr, block, block_start (0-based), seq: contigs in overlapping blocks, so
    that a fetch is an equi-join on (chr, block) and no genome is broadcast."""
    last = F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / block).cast("int"))
    d = contigs.select("chr", "seq", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return d.select("chr", "block", (F.col("block").cast("long") * block).alias("block_start"), F.substring("seq", F.col("block") * block + 1, F.lit(block + overlap)).alias("seq"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """feature, chr, gene_id, transcript_id, gene_name, strand, start_pos, end_pos; absent attributes are ''."""
    c = F.split("value", "\t")
    d = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(c.alias("c")).where(F.size("c") >= 9)
    at = lambda i: F.get("c", F.lit(i))
    attr = lambda k: F.regexp_extract(at(8), rf'{k} "([^"]*)"', 1).alias(k)
    return d.select(at(2).alias("feature"), at(0).alias("chr"), attr("gene_id"), attr("transcript_id"), attr("gene_name"), at(6).alias("strand"), at(3).cast("long").alias("start_pos"), at(4).cast("long").alias("end_pos"))


def mapped_rows(aln: DataFrame) -> DataFrame:
    """Alignments that are neither unmapped nor secondary; supplementary ones stay."""
    flag = F.col("flag")
    return aln.where((flag.bitwiseAND(UNMAPPED) == 0) & (flag.bitwiseAND(SECONDARY) == 0))


def sam(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    d = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(c.alias("c")).where(F.size("c") >= 11)
    at = lambda i: F.get("c", F.lit(i))
    return d.select(at(0).alias("query_id"), at(1).cast("int").alias("flag"), at(2).alias("chr"), (at(3).cast("long") - 1).alias("ref_begin"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"))


def _bam_rows(data: bytes) -> Iterator[tuple]:
    f = gzip.open(io.BytesIO(data))
    number = lambda: struct.unpack("<i", f.read(4))[0]
    if f.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    f.read(number())
    names = []
    for _ in range(number()):
        names.append(f.read(number())[:-1].decode())
        number()
    while head := f.read(4):
        r = f.read(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", r)
        at = 32 + n_name
        ops = struct.unpack_from(f"<{n_cigar}I", r, at)
        at += 4 * n_cigar
        half = r[at : at + (n_seq + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in half)[:n_seq]
        cigar = "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or "*"
        yield r[32 : 31 + n_name].decode(), flag, names[ref] if ref >= 0 else "*", pos, mapq, cigar, seq or "*"


def bam(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        names = ["query_id", "flag", "chr", "ref_begin", "mapq", "cigar", "seq"]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            held: list[tuple] = []
            for content in b.column("content").to_pylist():
                for row in _bam_rows(content):
                    held.append(row)
                    if len(held) == 10_000:
                        yield make(held)
                        held = []
            if held:
                yield make(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SAM_SCHEMA)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """read_id and cluster_id of a cluster table; a read listed twice keeps its last cluster, by file and line."""
    c = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).select(c.alias("c"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")).where(F.size("c") >= 4)
    d = d.select(F.get("c", F.lit(0)).alias("cluster_id"), F.get("c", F.lit(3)).alias("read_id"), "at")
    return d.groupBy("read_id").agg(F.max_by("cluster_id", "at").alias("cluster_id"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of candidate records: read_id, circ_id, strand, isoform_id, splice_site; molecules.with_clusters
    adds the reads' clusters."""
    c = F.split(F.substring("value", 2, 1 << 30), "\t")
    at = lambda i, n: F.trim(F.get("c", F.lit(i))).alias(n)
    d = spark.read.text(path).where(F.col("value").startswith(">")).select(c.alias("c"))
    return d.select(at(0, "read_id"), at(1, "circ_id"), at(2, "strand"), at(3, "isoform_id"), at(4, "splice_site"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema)


def read_lengths(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.length("seq").alias("len"))
