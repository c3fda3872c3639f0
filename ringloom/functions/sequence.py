"""Column functions over sequences, CIGARs, intervals and ids; all of them run in the JVM.

Positions named ``*0`` are 0-based half-open, all others 1-based closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes as bit masks, T = 1, C = 2, G = 4, A = 8.
IUPAC = {"-": 0, "T": 1, "C": 2, "Y": 3, "G": 4, "K": 5, "S": 6, "B": 7, "A": 8, "W": 9, "M": 10, "H": 11, "R": 12, "D": 13, "V": 14, "N": 15}


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def reverse_quality(qual: Column) -> Column:
    """Qualities of the reverse complement."""
    return F.reverse(qual)


def cigar_text(steps: Column) -> Column:
    """CIGAR of an array of structs (n, op)."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["n"].cast("string"), s["op"])), "")


def bounded_distance(a: Column, b: Column, most: int = 3) -> Column:
    """Edit distance of two short words, ``most`` for that and more."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most).otherwise(F.least(d, F.lit(most)))


def tsv_line(*fields: Column) -> Column:
    """Fields as one tab-separated line; null is empty."""
    return F.concat_ws("\t", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def alignment_line(query: Column, chrom: Column, strand: Column, exons: Column, exon_len: Column, query_start: Column, query_end: Column, left: Column, right: Column) -> Column:
    """An exon-block alignment as a line: bounds, comma-joined exon bounds, length, strand, flanks."""
    side = lambda f: joined(F.transform(exons, lambda e: e[f]))
    return tsv_line(query, chrom, F.get(exons, F.lit(0))["start"], F.element_at(exons, -1)["end"], query_start, query_end, side("start"), side("end"), exon_len, strand, left, right)


def circle_line(query: Column, chrom: Column, strand: Column, start: Column, end: Column, exons: Column) -> Column:
    """A read's circle as a line: ids, bounds, comma-joined exon bounds, length."""
    side = lambda f: joined(F.transform(exons, lambda e: e[f]))
    return tsv_line(query, chrom, strand, start, end, side("start"), side("end"), exon_length(exons), circ_id(chrom, start, end, strand), F.concat(circ_id(chrom, start, end, strand), F.lit("|"), exon_text(exons)))


def iupac_mask(base: Column) -> Column:
    """Bit mask of one IUPAC letter; unknown letters are 0."""
    out = F.lit(0)
    for letter, mask in IUPAC.items():
        out = F.when(base == letter, mask).otherwise(out)
    return out


def iupac_match(a: Column, b: Column) -> Column:
    """Whether two IUPAC letters have a base in common."""
    return iupac_mask(a).bitwiseAND(iupac_mask(b)) != 0


def first_token(name: Column) -> Column:
    return F.regexp_extract(name, r"^\s*(\S+)", 1)


def ints(text: Column) -> Column:
    """Comma-separated integers as an array; a closing comma is allowed."""
    return F.transform(F.array_remove(F.split(text, ","), ""), lambda x: x.cast("int"))


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def zipped_exons(starts: Column, ends: Column) -> Column:
    return F.zip_with(ints(starts), ints(ends), lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def exon_length(exons: Column) -> Column:
    """Sum of end - start + 1."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open intervals meet."""
    return (a0 < b1) & (b0 < a1)


def fetched(seq: Column, start0: Column, end0: Column) -> Column:
    """Slice of a contig: '' without a contig, 'NA' beyond its end."""
    return F.when(seq.isNull(), "").when(F.length(seq) < end0, "NA").otherwise(F.substring(seq, (start0 + 1).cast("int"), (end0 - start0).cast("int")))


def spliced(seq: Column, exons: Column) -> Column:
    """Joined slices of 0-based half-open exons."""
    return F.array_join(F.transform(exons, lambda e: fetched(seq, e["start"], e["end"])), "")


def segments_of(segments: Column, raw: Column) -> Column:
    """Substrings that a text of 0-based ``start-end`` parts, split by ``;``, names."""
    part = lambda s: F.split(s, "-")
    return F.transform(F.split(segments, ";"), lambda s: F.substring(raw, F.get(part(s), F.lit(0)).cast("int") + 1, F.get(part(s), F.lit(1)).cast("int") - F.get(part(s), F.lit(0)).cast("int")))


def circ_id(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    base = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return base if strand is None else F.concat(base, F.lit(":"), strand)


def exon_text(exons: Column) -> Column:
    return F.array_join(F.transform(exons, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")


def cigar_blocks(cigar: Column, begin0: Column) -> Column:
    """Struct of exons (0-based half-open), query_start, query_end.

    M, =, X and D move along the reference, N closes a block, M, I, =, X move along
    the query; clips before the first of those move the query's begin and end."""
    size, kind = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    steps = F.zip_with(size, kind, lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    long = begin0.cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(long.alias("block"), long.alias("at"), none.alias("exons"), F.lit(0).cast("long").alias("q0"), F.lit(0).cast("long").alias("q1"), F.lit(False).alias("inside"))

    def step(a: Column, s: Column) -> Column:
        ref = F.when(s["k"].isin("M", "=", "X", "D", "N"), s["n"]).otherwise(0)
        query = F.when(s["k"].isin("M", "=", "X", "I"), s["n"]).otherwise(0)
        clip = F.when(s["k"].isin("S", "H") & ~a["inside"], s["n"]).otherwise(0)
        cut = s["k"] == "N"
        return F.struct(
            F.when(cut, a["at"] + ref).otherwise(a["block"]).alias("block"), (a["at"] + ref).alias("at"),
            F.when(cut & (a["at"] > a["block"]), F.array_append(a["exons"], F.struct(a["block"].alias("start"), a["at"].alias("end")))).otherwise(a["exons"]).alias("exons"),
            (a["q0"] + clip).alias("q0"), (a["q1"] + clip + query).alias("q1"), (a["inside"] | (query + ref > 0)).alias("inside"),
        )

    def done(a: Column) -> Column:
        last = F.array_append(a["exons"], F.struct(a["block"].alias("start"), a["at"].alias("end")))
        return F.struct(F.when(a["at"] > a["block"], last).otherwise(a["exons"]).alias("exons"), a["q0"].alias("query_start"), a["q1"].alias("query_end"))

    return F.aggregate(steps, start, step, done)


def is_retained_intron(start: Column, end: Column, exons: Column, tol: int = 10) -> Column:
    """Both ends lie within tol of the ends of one intron of a base or more (exons sorted by start)."""
    gap = lambda i: (F.get(exons, i)["end"] + 1 < F.get(exons, i + 1)["start"]) & (F.abs(start - F.get(exons, i)["end"] - 1) <= tol) & (F.abs(end - F.get(exons, i + 1)["start"] + 1) <= tol)
    return F.when(F.size(exons) > 1, F.exists(F.sequence(F.lit(0), F.size(exons) - 2), gap)).otherwise(False)


def best_exon(start: Column, end: Column, exons: Column) -> Column:
    """Index of the exon with the largest overlap, the difference of the bounds; the first of
    equal ones; null without overlap."""
    width = lambda e: F.least(end, e["end"]) - F.greatest(start, e["start"])
    scored = F.transform(exons, lambda e, i: F.struct(width(e).alias("w"), (-i).alias("i")))
    return -F.array_max(F.filter(scored, lambda s: s["w"] > 0))["i"]


def exon_token(start: Column, end: Column, exons: Column, strand: Column, tol: int = 10) -> Column:
    """Number of the best reference exon from 5', with L where the circle's exon
    reaches over its 3' end and S where it starts short of its 5' end, by more
    than tol; without an overlapping exon RI for a retained intron, else NE."""
    i = best_exon(start, end, exons)
    ref, plus = F.get(exons, i), strand == "+"
    number = F.when(strand == "-", F.size(exons) - i).otherwise(i + 1).cast("string")
    longer = F.when(plus, end - ref["end"] > tol).otherwise(ref["start"] - start > tol)
    shorter = F.when(plus, start - ref["start"] > tol).otherwise(ref["end"] - end > tol)
    token = F.concat(F.when(longer, "L").otherwise(""), number, F.when(shorter, "S").otherwise(""))
    return F.when(i.isNotNull(), token).when(is_retained_intron(start, end, exons, tol), "RI").otherwise("NE")


def uniform_id(gene: Column, circ: Column, exons: Column, ref: Column, strand: Column) -> Column:
    """circGENE(token,token), tokens from 5'; circIntergenic(chr:s-e:strand) without a gene."""
    tokens = F.transform(exons, lambda e: exon_token(e["start"], e["end"], ref, strand))
    tokens = F.when(strand == "-", F.reverse(tokens)).otherwise(tokens)
    return F.when(gene.isNull() | (gene == ""), F.concat(F.lit("circIntergenic("), circ, F.lit(")"))).otherwise(F.concat(F.lit("circ"), gene, F.lit("("), F.array_join(tokens, ","), F.lit(")")))
