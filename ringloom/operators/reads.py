"""Reads and their alignments: type router, top alignments, isoforms, fusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.sequence import overlaps
from ringloom.operators.relational import interval_union, mode_of, top_row

GAP = 40


def _alternates(code: Column) -> Column:
    """Neighbours of an array of codes always differ."""
    return F.forall(F.sequence(F.lit(0), F.size(code) - 2), lambda i: F.get(code, i) != F.get(code, i + 1))


def _gaps(a: Column, start: str, end: str, far: bool) -> Column:
    """The distance rule on the first four alignments: same-locus passes are more
    than GAP apart, and successive query passes overlap by less than GAP."""
    q = lambda i, f: F.get(a, F.lit(i))[f]
    first = (q(2, start) - q(0, end) > GAP) & (q(3, start) - q(1, end) > GAP)
    ends = (q(1, "query_end") - q(0, "query_end") > GAP) & (q(2, "query_end") - q(1, "query_end") > GAP) & (q(3, "query_end") - q(2, "query_end") > GAP) if far else F.lit(True)
    near = (q(1, "query_start") - q(0, "query_end") > -GAP) & (q(2, "query_start") - q(1, "query_end") > -GAP) & (q(3, "query_start") - q(2, "query_end") > -GAP) if far else (q(1, start) - q(0, end) > -GAP) & (q(2, start) - q(1, end) > -GAP) & (q(3, start) - q(2, end) > -GAP)
    mid = F.lit(True) if far else (q(1, end) - q(0, end) > GAP) & (q(2, end) - q(1, end) > GAP) & (q(3, end) - q(2, end) > GAP)
    return first & ends & near & mid


def read_types(aln: DataFrame, remapped: Column | None = None) -> DataFrame:
    """query_id, n_aln, n_chr, n_switch, min_gap (least query distance of neighbours), read_type of reads
    with two alignments or more.

    aln: query_id, chr, strand, ref_start, ref_end (0-based half-open), query_start,
    query_end, exon_len. remapped: an aggregate telling whether the read maps
    repeatedly to one of its own alignments; false if not given."""
    rec = F.struct("query_start", "query_end", "ref_start", "ref_end", "chr", "strand", "exon_len")
    again = F.lit(False) if remapped is None else remapped
    g = aln.groupBy("query_id").agg(F.array_sort(F.collect_list(rec)).alias("a"), again.alias("again")).where(F.size("a") >= 2)
    a, n = F.col("a"), F.size("a")
    chrs = F.transform(a, lambda x: x["chr"])
    g = g.withColumns({
        "n_chr": F.size(F.array_distinct(chrs)),
        "n_switch": F.size(F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.get(a, i)["chr"] != F.get(a, i + 1)["chr"])),
        "min_gap": F.array_min(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.abs(F.get(a, i + 1)["query_start"] - F.get(a, i)["query_end"]))),
        "n_locus": F.size(F.array_distinct(F.transform(a, lambda x: F.struct(x["chr"], x["strand"])))),
    })
    at = lambda i: F.get(a, F.lit(i))
    ovl = lambda x, y: overlaps(x["ref_start"], x["ref_end"], y["ref_start"], y["ref_end"])
    # the longest alignment, the first of equal ones
    longest = F.get(a, -F.array_max(F.transform(a, lambda x, i: F.struct(x["exon_len"].alias("l"), (-i).alias("i"))))["i"])
    over = F.transform(a, lambda x: ovl(x, longest))
    hits = F.size(F.filter(over, lambda x: x))
    again = F.col("again")
    one = (
        F.when(n == 2, F.when(ovl(at(0), at(1)) | again, "sameChrCandidate").otherwise("sameChrNotCandidate"))
        .when((n == 3) & (ovl(at(0), at(1)) | ovl(at(0), at(2))) & (ovl(at(2), at(1)) | ovl(at(2), at(0))), F.when(ovl(at(0), at(1)) | again, "sameChrCandidate").otherwise("sameChrFusionLowConf"))
        .when(n == 3, F.when(again, "sameChrCandidate").otherwise("sameChrLowConf"))
        .when((hits > n - 2) | again, "sameChrCandidate")
        .when(~_alternates(over), "sameChrLowConf")
        .when(_gaps(a, "ref_start", "ref_end", False), "sameChrFusion")
        .otherwise("sameChrFusionLowConf")
    )
    two = (
        F.when(F.col("n_switch") <= 1, "twoChrLowConf").when(again, "sameChrCandidate").when(F.col("n_locus") > 2, "twoChrsNotCandidate")
        .when((n >= 4) & _alternates(chrs) & _gaps(a, "query_start", "query_end", True), "twoChrsFusion").otherwise("twoChrsFusionLowConf")
    )
    kind = F.when(F.col("n_chr") > 2, "multipleChrs").when(F.col("n_chr") == 2, two).otherwise(one)
    return g.select("query_id", n.cast("long").alias("n_aln"), F.col("n_chr").cast("long").alias("n_chr"), F.col("n_switch").cast("long").alias("n_switch"), F.col("min_gap").cast("long").alias("min_gap"), kind.alias("read_type"))


def top_alignment(aln: DataFrame) -> DataFrame:
    """Each read's longest alignment; ties by position."""
    return top_row(aln, ["query_id"], F.desc("exon_len"), "query_start", "chr", "ref_start", "ref_end", "strand", "query_end")


def merged_exons(exons: DataFrame) -> DataFrame:
    """Union of all exons (query_id, exon_start, exon_end) of a read."""
    return interval_union(exons.where("exon_end > exon_start"), ["query_id"], "exon_start", "exon_end")


def isoforms(exons: DataFrame, junctions: DataFrame, hang: int = 300, least: int = 10) -> DataFrame:
    """One row per exon of each read's isoform: query_id, chr, strand, exon_no, exon_start, exon_end (1-based).

    exons: query_id, aln (number of the alignment), chr, ref_start, ref_end, exon_len,
    n_exons, exon_no (from 0), exon_start, exon_end (0-based). junctions: query_id,
    chr, strand, start_pos, end_pos. Alignments that reach both junction ends within
    ``hang`` compete by exon count, then length; all the best ones vote on each
    exon's modal bounds. The outer bounds are the junction's; exons of a span up to ``least`` go."""
    j = exons.join(junctions, ["query_id", "chr"]).where((F.abs(F.col("ref_start") - F.col("start_pos")) <= hang) & (F.abs(F.col("ref_end") - F.col("end_pos")) <= hang))
    best = j.groupBy("query_id").agg(F.max(F.struct("n_exons", "exon_len")).alias("b"))
    j = j.join(best, "query_id").where("n_exons = b.n_exons and exon_len = b.exon_len")
    first, last = F.col("exon_no") == 0, F.col("exon_no") == F.col("n_exons") - 1
    j = j.withColumns({"s": F.when(first, F.col("start_pos")).otherwise(F.col("exon_start") + 1), "e": F.when(last, F.col("end_pos")).otherwise(F.col("exon_end"))})
    voted = mode_of(j, ["query_id", "chr", "strand", "exon_no"], ["s", "e"])
    return voted.where(F.col("e") - F.col("s") > least).select("query_id", "chr", "strand", F.col("exon_no").cast("long").alias("exon_no"), F.col("s").cast("long").alias("exon_start"), F.col("e").cast("long").alias("exon_end"))


def fusion_loci(aln: DataFrame) -> DataFrame:
    """aln with locus 1 or 2: by chromosome in order of appearance where a read has two,
    else by overlap with the longest alignment, or by turns where all overlap it; the locus met first is 1."""
    w = Window.partitionBy("query_id")
    order = ["query_start", "query_end", "ref_start", "ref_end", "chr", "strand"]
    longest = F.max(F.struct("exon_len", *((-F.col(c)).alias(c) for c in order[:4]), F.struct("ref_start", "ref_end", "chr").alias("at"))).over(w)["at"]
    d = aln.withColumn("_l", longest).withColumn("_c", F.min(F.struct(*order[:4], "chr")).over(w)["chr"])
    d = d.withColumn("_two", F.min("chr").over(w) != F.max("chr").over(w))
    side = F.when(F.col("_two"), F.col("chr") == F.col("_c")).otherwise(overlaps(F.col("ref_start"), F.col("ref_end"), F.col("_l.ref_start"), F.col("_l.ref_end")))
    d = d.withColumn("_a", side).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    d = d.withColumn("_a", F.when(~F.col("_two") & F.min("_a").over(w), F.col("_i") % 2 == 1).otherwise(F.col("_a"))).withColumn("_first", F.min(F.struct(*order[:4], "_a")).over(w)["_a"])
    return d.withColumn("locus", F.when(F.col("_a") == F.col("_first"), 1).otherwise(2)).drop("_l", "_c", "_two", "_a", "_first", "_i")


def fusion_pairs(aln: DataFrame) -> DataFrame:
    """One row per read with both loci: bounds, majority strands and counts; of
    two loci on one chromosome the one that starts first is left."""
    d = fusion_loci(aln)
    per = d.groupBy("query_id", "locus").agg(
        F.min("chr").alias("chr"), F.min("ref_start").alias("start"), F.max("ref_end").alias("end"), F.count("*").alias("n"),
        F.sum(F.when(F.col("strand") == "+", 1).otherwise(-1)).alias("plus"),
    )
    per = per.withColumn("strand", F.when(F.col("plus") >= 0, "+").otherwise("-"))
    rec = F.struct("chr", "start", "end", "strand", "n")
    p = per.groupBy("query_id").agg(F.max(F.when(F.col("locus") == 1, rec)).alias("a"), F.max(F.when(F.col("locus") == 2, rec)).alias("b")).where("a is not null and b is not null")
    swap = (F.col("a.chr") == F.col("b.chr")) & (F.col("b.start") < F.col("a.start"))
    x, y = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    out = [v[f].alias(f"{f}_{i}") for i, v in ((1, x), (2, y)) for f in ("chr", "start", "end", "strand", "n")]
    return p.select("query_id", *out)


def fusion_groups(pairs: DataFrame) -> DataFrame:
    """Reads of equal fusions: id, count and sorted comma-joined read ids."""
    side = lambda i: F.concat(F.col(f"chr_{i}"), F.lit(":"), F.col(f"start_{i}").cast("string"), F.lit("-"), F.col(f"end_{i}").cast("string"), F.lit(":"), F.col(f"strand_{i}"))
    d = pairs.select(F.concat(side(1), F.lit("|"), side(2)).alias("fusion_id"), "query_id")
    return d.groupBy("fusion_id").agg(F.count("*").alias("n_reads"), F.array_join(F.transform(F.array_sort(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("read_ids"))
