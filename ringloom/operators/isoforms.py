"""Isoform structure: exons snapped to annotation, rare isoforms moved to frequent ones, exon
bounds absorbed per circle, candidate rows of circles and loci of fusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.sequence import exon_length, exon_text, joined
from ringloom.operators.junctions import EXON_TOL, HANG, absorb_sites, nearest_of_genes, snap_to_genes
from ringloom.operators.reads import fusion_loci
from ringloom.operators.relational import band_join, mode_of, top_row
from ringloom.operators.storage import materialised

SITE = ["chr", "strand", "start_pos", "end_pos"]


def _exon(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def _regrouped(d: DataFrame, key: Sequence[str], start: Column, end: Column, name: str) -> DataFrame:
    """Rows (key, j, ...) of exons put together again, in the order of j."""
    d = d.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", start.alias("s"), end.alias("e")))).alias("_a"))
    return d.select(*key, F.transform("_a", lambda x: _exon(x["s"], x["e"])).alias(name))


def snapped(iso: DataFrame, key: Sequence[str], gtf: DataFrame, tol: int = EXON_TOL) -> DataFrame:
    """iso (key, chr, strand, exons) with every exon moved to the nearest bounds of the best gene that has
    bounds within tol of both its ends; the outer bounds stay as they are."""
    x = iso.select(*key, "chr", "strand", F.posexplode("exons").alias("j", "x")).select(*key, "chr", "strand", "j", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    return iso.drop("exons").join(_snapped_exons(x, key, gtf, tol).drop("chr", "strand"), list(key))


def _snapped_exons(x: DataFrame, key: Sequence[str], gtf: DataFrame, tol: int) -> DataFrame:
    """key, chr, strand, exons from rows of exons (key, chr, strand, j, s, e), snapped but for the outer bounds."""
    kinds = x.select(F.lit(0).alias("query_id"), "chr", "strand", F.col("s").alias("start_pos"), F.col("e").alias("end_pos")).distinct()
    to = snap_to_genes(kinds, gtf, tol).select("chr", "strand", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), "snap_start", "snap_end")
    d = x.join(to, ["chr", "strand", "s", "e"], "left")
    d = d.groupBy(*key, "chr", "strand").agg(F.array_sort(F.collect_list(F.struct("j", "s", "e", F.coalesce("snap_start", "s").alias("s2"), F.coalesce("snap_end", "e").alias("e2")))).alias("_a"))
    last = F.size("_a") - 1
    exons = F.transform("_a", lambda v, i: _exon(F.when(i == 0, v["s"]).otherwise(v["s2"]), F.when(i == last, v["e"]).otherwise(v["e2"])))
    return d.select(*key, "chr", "strand", exons.alias("exons"))


def to_confident(iso: DataFrame, tol: int = EXON_TOL) -> DataFrame:
    """iso (chr, strand, start_pos, end_pos, exons; a row per read) with isoforms of one read moved to those
    of several reads of the same circle and number of exons: each bound goes to the
    nearest one at its place that is less than tol away, the least of equal ones."""
    kinds = iso.groupBy(*SITE, "exons").agg(F.count("*").alias("n"))
    x = kinds.select(*SITE, "exons", "n", F.size("exons").alias("m"), F.posexplode("exons").alias("j", "x")).select(*SITE, "exons", "n", "m", "j", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    high, low = x.where("n > 1"), x.where("n = 1")
    key = [*SITE, "m", "j"]

    def nearest(c: str) -> DataFrame:
        there = high.select(*key, F.col(c).alias("h")).distinct()
        near = band_join(low.select(*key, c).distinct(), there, key, c, "h", tol - 1)
        return near.groupBy(*key, c).agg(F.min(F.struct(F.abs(F.col("h") - F.col(c)).alias("d"), "h"))["h"].alias(f"to_{c}"))

    d = low.join(nearest("s"), [*key, "s"], "left").join(nearest("e"), [*key, "e"], "left")
    moved = _regrouped(d, [*SITE, "exons"], F.coalesce("to_s", "s"), F.coalesce("to_e", "e"), "_moved")
    return iso.join(moved, [*SITE, "exons"], "left").withColumn("exons", F.coalesce("_moved", "exons")).drop("_moved")


def absorb_bounds(iso: DataFrame, tol: int = EXON_TOL) -> DataFrame:
    """iso (chr, strand, start_pos, end_pos, exons; a row per read) with the exon starts of each circle, and its
    exon ends apart from them, absorbed greedily into better supported ones within tol."""
    circle = F.concat_ws("\t", *(F.col(c).cast("string") for c in SITE))
    kinds = iso.groupBy(*SITE, "exons").agg(F.count("*").alias("n")).withColumn("k", circle)
    x = kinds.select(*SITE, "exons", "n", "k", F.posexplode("exons").alias("j", "x")).select(*SITE, "exons", "n", "k", "j", F.col("x.start").alias("s"), F.col("x.end").alias("e"))

    def to(c: str) -> DataFrame:
        sites = x.groupBy("k", c).agg(F.sum("n").alias("n"))
        rows = sites.select(F.col("k").alias("chr"), F.lit("").alias("strand"), F.col(c).alias("start_pos"), F.lit(0).cast("long").alias("end_pos"), "n")
        return absorb_sites(rows, tol).select(F.col("chr").alias("k"), F.col("start_pos").alias(c), F.col("to_start").alias(f"to_{c}"))

    d = x.join(to("s"), ["k", "s"]).join(to("e"), ["k", "e"])
    moved = _regrouped(d, [*SITE, "exons"], F.col("to_s"), F.col("to_e"), "_moved")
    return iso.join(moved, [*SITE, "exons"]).withColumn("exons", F.col("_moved")).drop("_moved")


def _union(exons: Column) -> Column:
    """Touching and overlapping intervals of a sorted array merged."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.array_append(F.slice(a, 1, F.size(a) - 1), _exon(last["start"], F.greatest(last["end"], x["end"])))
        return F.when(F.size(a) == 0, F.array(_exon(x["start"], x["end"]))).when(x["start"] <= F.try_element_at(a, F.lit(-1))["end"], grown).otherwise(F.array_append(a, _exon(x["start"], x["end"])))

    return F.aggregate(exons, none, step)


def candidate_rows(recs: DataFrame, types: DataFrame, again: DataFrame | None = None, hang: int = HANG) -> DataFrame:
    """The alignments of circle candidates that go on: the first row that the read maps to
    repeatedly, if there is one; of two other rows whose starts are more than
    ``hang`` apart their union; else all rows.

    recs: query_id, aln (number of the row), chr, strand, ref_start, ref_end, query_start, query_end, exons,
    exon_len. again: (query_id, aln) of rows mapped to repeatedly."""
    d = recs.join(types.where("read_type = 'sameChrCandidate'").select("query_id"), "query_id", "left_semi")
    order = ["query_start", "query_end", "ref_start", "ref_end", "chr", "strand", "aln"]
    if again is None:
        one, rest = d.limit(0), d
    else:
        one = top_row(d.join(again.select("query_id", "aln"), ["query_id", "aln"], "left_semi"), ["query_id"], *(F.col(c) for c in order))
        rest = d.join(again.select("query_id").distinct(), "query_id", "left_anti")
    both = rest.groupBy("query_id").agg(
        F.count("*").alias("n"), (F.max("ref_start") - F.min("ref_start")).alias("apart"), F.min(F.struct(*order)).alias("f"), F.min("aln").alias("aln"), F.min("chr").alias("chr"),
        F.min("ref_start").alias("ref_start"), F.max("ref_end").alias("ref_end"), F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"),
    ).where((F.col("n") == 2) & (F.col("apart") > hang))
    pooled = rest.join(both.select("query_id"), "query_id", "left_semi").select("query_id", F.explode("exons").alias("x")).groupBy("query_id").agg(_union(F.array_sort(F.collect_list("x"))).alias("exons"))
    both = both.withColumn("strand", F.col("f.strand")).join(pooled, "query_id").withColumn("exon_len", F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"]))
    rest = rest.join(both.select("query_id"), "query_id", "left_anti")
    cols = recs.columns
    return one.select(*cols).union(both.select(*cols)).union(rest.select(*cols))


# --- fusions -------------------------------------------------------------------


def fusion_structure(aln: DataFrame, gtf: DataFrame, tol: int = EXON_TOL, least: int = 10) -> DataFrame:
    """query_id, locus (1 or 2), chr, strand, exons of both loci of each read.

    Of a locus' alignments (with ``exons``) those with most exons, then the longest, vote on the bounds of
    each exon; exons of a span up to ``least`` go, the others are snapped. The strand is
    the more frequent one of these alignments. Reads without both loci go; of
    two loci on one chromosome the one that starts first is locus 1."""
    # all of a read is dealt out once: windows and groups within it need no other shuffle
    d = fusion_loci(aln).withColumn("m", F.size("exons"))
    key = ["query_id", "locus"]
    w = Window.partitionBy(*key)
    d = d.withColumn("b", F.max(F.struct("m", "exon_len")).over(w)).where("m = b.m and exon_len = b.exon_len")
    plus = F.sum(F.when(F.col("strand") == "+", 1).otherwise(-1)).over(w) >= 0
    d = d.select(*key, F.min("chr").over(w).alias("chr"), F.when(plus, "+").otherwise("-").alias("strand"), F.posexplode("exons").alias("j", "x"))
    x = d.select(*key, "chr", "strand", "j", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    voted = materialised(mode_of(x, [*key, "chr", "strand", "j"], ["s", "e"]).where(F.col("e") - F.col("s") > least).drop("n"))
    loci = _snapped_exons(voted, key, gtf, tol).withColumn("exons", F.array_sort("exons"))
    loci = loci.withColumn("first", F.get("exons", F.lit(0))["start"])
    w = Window.partitionBy("query_id")
    loci = loci.withColumn("n", F.count("*").over(w)).where("n = 2")
    one = (F.min("chr").over(w) == F.max("chr").over(w)) & (F.min(F.when(F.col("locus") == 1, F.col("first"))).over(w) > F.min(F.when(F.col("locus") == 2, F.col("first"))).over(w))
    return loci.withColumn("_swap", one).select("query_id", F.when(F.col("_swap"), 3 - F.col("locus")).otherwise(F.col("locus")).cast("int").alias("locus"), "chr", "strand", "exons")


def locus_genes(exons: DataFrame, key: Sequence[str], gtf: DataFrame, tol: int = EXON_TOL) -> DataFrame:
    """key, genes: the sorted names (else ids) of all genes that have bounds within tol of both ends of
    one exon (key, chr, strand, s, e), on its strand or an unknown one, joined by commas."""
    both = exon_genes(exons.select("chr", "strand", "s", "e").distinct(), gtf, tol)
    return exons.join(both, ["chr", "strand", "s", "e"]).groupBy(*key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("genes"))


def exon_genes(kinds: DataFrame, gtf: DataFrame, tol: int) -> DataFrame:
    """Distinct exons (chr, strand, s, e) with ``names`` of the genes that have bounds within tol of both ends; the
    others are left out."""
    any_ = F.when(F.col("strand") == ".", F.array(*map(F.lit, "+-."))).otherwise(F.array("strand"))
    rows = gtf.where("gene_id is not null").withColumn("strand", F.explode(any_))
    sites = ["chr", "strand", "s", "e"]
    start = nearest_of_genes(kinds.select("chr", "strand", F.col("s").alias("start_pos")), rows, "start_pos", tol).select("chr", "strand", F.col("start_pos").alias("s"), F.col("near.gene_id").alias("_s"))
    end = nearest_of_genes(kinds.select("chr", "strand", F.col("e").alias("end_pos")), rows, "end_pos", tol).select("chr", "strand", F.col("end_pos").alias("e"), F.col("near.gene_id").alias("_e"))
    both = kinds.join(start, ["chr", "strand", "s"]).join(end, ["chr", "strand", "e"]).select(*sites, F.explode(F.array_intersect("_s", "_e")).alias("gene_id"))
    name = F.min(F.when(F.col("gene_name") != "", F.col("gene_name"))) if "gene_name" in gtf.columns else F.lit(None)
    names = gtf.groupBy("gene_id").agg(F.coalesce(name, "gene_id").alias("name"))
    return both.join(names, "gene_id").groupBy(*sites).agg(F.collect_set("name").alias("names"))


def fusion_table(loci: DataFrame, gtf: DataFrame, flank, tol: int = EXON_TOL) -> DataFrame:
    """The 26 columns of the fusion table, a row per isoform of a fusion, from the reads' loci
    (fusion_structure). flank: adds the column name with the two bases that begin at the 0-based
    position column, flank(rows, position, name)."""
    rec = F.struct("chr", "strand", "exons")
    side = lambda i: F.max(F.when(F.col("locus") == i, rec))
    reads = loci.groupBy("query_id").agg(side(1).alias("a"), side(2).alias("b"))
    start, end = lambda v: F.get(v["exons"], F.lit(0))["start"], lambda v: F.element_at(v["exons"], -1)["end"]
    text = lambda v: F.concat(v["chr"], F.lit(":"), exon_text(v["exons"]), F.lit(":"), v["strand"])
    span = lambda v: F.concat(v["chr"], F.lit(":"), start(v).cast("string"), F.lit("-"), end(v).cast("string"), F.lit(":"), v["strand"])
    a, b = F.col("a"), F.col("b")
    # the first read of an isoform stands for it
    iso = reads.withColumn("isoID", F.concat(text(a), F.lit("|"), text(b))).where("isoID is not null").groupBy("isoID").agg(
        F.min(F.struct("query_id", "a", "b")).alias("o"), F.count("*").alias("readCount"), F.array_join(F.transform(F.array_sort(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("readID"),
    )
    iso = materialised(iso.select("isoID", "o.*", "readCount", "readID"))
    loci = iso.select("query_id", F.posexplode(F.array("a", "b")).alias("locus", "v"))
    x = loci.select("query_id", "locus", "v.chr", "v.strand", F.posexplode("v.exons").alias("j", "x")).select("query_id", "locus", "chr", "strand", "j", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    # genes and flanks are looked up once per distinct exon and place
    kinds = materialised(x.select("chr", "strand", "s", "e").distinct())
    left = flank(kinds.select("chr", "s", (F.col("s") - 2).alias("_b")).distinct(), "_b", "l").select("chr", "s", "l")
    right = flank(kinds.select("chr", "e").distinct(), "e", "r").select("chr", "e", "r")
    kinds = kinds.join(left, ["chr", "s"]).join(right, ["chr", "e"]).join(exon_genes(kinds, gtf, tol), ["chr", "strand", "s", "e"], "left")
    q = x.join(kinds, ["chr", "strand", "s", "e"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("locus", "j", "l", "r", "names"))).alias("q"))
    iso = iso.join(q, "query_id")

    def parts(v: Column, i: int) -> dict[str, Column]:
        own = F.filter("q", lambda r: r["locus"] == i)
        at = lambda f: joined(F.transform(v["exons"], lambda x: x[f]))
        base = lambda f: F.array_join(F.transform(own, lambda r: r[f]), ",")
        genes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(own, lambda r: r["names"]), lambda n: n.isNotNull())))), ",")
        return {
            "chr": v["chr"], "start": start(v), "end": end(v), "len": exon_length(v["exons"]), "exonNum": F.size(v["exons"]), "exon_start": at("start"), "exon_end": at("end"),
            "exon_leftSeq": base("l"), "exon_rightSeq": base("r"), "strand": v["strand"], "geneName": F.when(genes == "", "intergenic").otherwise(genes),
        }

    columns = [c.alias(f"{n}_{name}") for i, (v, name) in enumerate(((a, "first"), (b, "second"))) for n, c in parts(v, i).items()]
    return iso.select(F.concat(span(a), F.lit("|"), span(b)).alias("circID"), "isoID", *columns, "readCount", "readID")
