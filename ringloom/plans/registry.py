"""Registered queries of the engine and their DuckDB SQL.

Each query applies operators to a whole view; the SQL states the same result by
plain joins, aggregates and windows. Queries of kernels that SQL cannot express
have none and are tested against brute force and known answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions import sequence as S
from ringloom.operators import annotate as A
from ringloom.operators import isoforms as I
from ringloom.operators import junctions as J
from ringloom.operators import kernels as K
from ringloom.operators import molecules as M
from ringloom.operators import reads as R
from ringloom.operators import relational as rel
from ringloom.plans import views as V
from ringloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


E, C, SI, H, AL, AX, RS, MO, SQ = (v.sql for v in (V.EXONS, V.CANDS, V.SITES, V.HYPOTHESES, V.ALIGNMENTS, V.ALN_EXONS, V.READ_SITES, V.MOLECULES, V.SEQUENCES))

# --- junctions ----------------------------------------------------------------


@_query(f"""
with c as {C}, e as {E},
s as (select query_id, gene_id, min(row(abs(e.start_pos - c.start_pos), e.start_pos)) as s from c join e on c.chr = e.chr and c.strand = e.strand and abs(e.start_pos - c.start_pos) <= 40 group by all),
t as (select query_id, gene_id, min(row(abs(e.end_pos - c.end_pos), e.end_pos)) as t from c join e on c.chr = e.chr and c.strand = e.strand and abs(e.end_pos - c.end_pos) <= 40 group by all),
b as (select query_id, gene_id, s[2] as snap_start, t[2] as snap_end, s[1] + t[1] as shift, row_number() over (partition by query_id order by s[1] + t[1], gene_id) as r from s join t using (query_id, gene_id))
select query_id, chr, strand, start_pos, end_pos, gene_id, snap_start, snap_end, shift from b join c using (query_id) where r = 1""")
def bsj_snap_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.snap_to_genes(V.CANDS.frame(spark, sf_dir), V.EXONS.rows(spark, sf_dir))


@_query(f"""
with c as {C}, m as (select *, max(end_pos) over (partition by chr order by start_pos, end_pos, query_id rows between unbounded preceding and 1 preceding) as reach from c),
i as (select *, sum(case when reach is null or start_pos > reach then 1 else 0 end) over (partition by chr order by start_pos, end_pos, query_id) as island from m)
select chr, min(start_pos) as island_start, max(end_pos) as island_end, count(*) as n from i group by chr, island""")
def bsj_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.islands(V.CANDS.frame(spark, sf_dir), "chr", "start_pos", "end_pos")


_HIGH = f"s as {SI}, k as (select chr, strand, start_pos, end_pos from s where left_ok and right_ok group by all having count(*) >= 2), hi as (select s.* from s semi join k using (chr, strand, start_pos, end_pos)), lo as (select s.* from s anti join k using (chr, strand, start_pos, end_pos))"


@_query(f"with {_HIGH} select query_id, 'high' as confidence from hi union all select query_id, 'low' from lo")
def bsj_high_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = J.high_confidence(V.SITES.frame(spark, sf_dir))
    return high.select("query_id", F.lit("high").alias("confidence")).union(low.select("query_id", F.lit("low")))


_LOWHIGH = f"""{_HIGH}, h as (select distinct chr, strand, start_pos as h_start, end_pos as h_end from hi),
a as (select lo.query_id, lo.chr, lo.strand, lo.start_pos, lo.end_pos, min(row(abs(lo.start_pos - h_start) + abs(lo.end_pos - h_end), h_start, h_end)) as b from lo join h on lo.chr = h.chr and lo.strand = h.strand and abs(lo.start_pos - h_start) <= 40 and abs(lo.end_pos - h_end) <= 40 group by all)"""


@_query(f"with {_LOWHIGH} select query_id, chr, strand, start_pos, end_pos, b[2] as adj_start, b[3] as adj_end from a")
def bsj_low_to_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = J.high_confidence(V.SITES.frame(spark, sf_dir))
    return J.low_to_high(low, high)


_RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"
_MOTIFS = "m as (select substring(x, 1, 2) as l, substring(x, 3, 2) as r from (values ('AGGT'), ('AGGC'), ('ACAT'), ('ACGT'), ('AGAT')) v(x))"


@_query(f"""
with h as {H}, {_MOTIFS},
n as (select *, count(*) as n from h group by all),
t as (select * from n qualify n = max(n) over (partition by query_id)),
f as (select t.*, l, r, case strand when '+' then left_seq = l else left_seq = {_RC.format('r')} end as lok, case strand when '+' then right_seq = r else right_seq = {_RC.format('l')} end as rok from t, m),
b as (select query_id, chr, start_pos, end_pos, strand, left_seq, right_seq, 0 as tier, sum(n) over (partition by query_id, l, r, strand) as votes, true as left_ok, true as right_ok from f where lok and rok),
o as (select query_id, chr, start_pos, end_pos, strand, left_seq, right_seq, 1 as tier, sum(n) over (partition by query_id, lok, case when lok then l else r end, strand) as votes, lok as left_ok, rok as right_ok from f where lok <> rok),
u as (select * from b union all select * from o union all select query_id, chr, start_pos, end_pos, strand, left_seq, right_seq, 2, 0, false, false from t)
select query_id, chr, start_pos, end_pos, strand, left_seq, right_seq, tier, left_ok, right_ok from u where end_pos > start_pos
qualify row_number() over (partition by query_id order by tier, votes desc, end_pos - start_pos desc, left_ok desc, chr, start_pos, end_pos, strand, left_seq, right_seq) = 1""")
def bsj_motif_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.vote_junction(V.HYPOTHESES.frame(spark, sf_dir), J.motif_rows(spark))


@_query()
def bsj_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.absorb_sites(V.SITES.frame(spark, sf_dir))


@_query()
def bsj_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cluster_junctions(V.SITES.frame(spark, sf_dir))


@_query(f"with s as {SI} select chr, strand, start_pos, end_pos, count(*) as n_reads from s group by all having count(*) >= 2")
def isoform_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.support(V.SITES.frame(spark, sf_dir), ["chr", "strand", "start_pos", "end_pos"], 2)


@_query(f"with s as {SI}, k as (select chr, strand, start_pos, end_pos, count(*) as n_reads from s group by all having count(*) >= 2) select *, (sum(n_reads) over w)::bigint as site_reads, count(*) over w as n_isoforms from k window w as (partition by chr, strand, start_pos)")
def bsj_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rollup_support(V.SITES.frame(spark, sf_dir), ["chr", "strand", "start_pos"], ["end_pos"], 2)


@_query(f"with h as {H}, n as (select query_id, strand, count(*) as n from h group by all) select query_id, strand from n qualify row_number() over (partition by query_id order by n desc, strand) = 1")
def strand_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.majority_strand(V.HYPOTHESES.frame(spark, sf_dir), ["query_id"])


@_query(f"with h as {H}, n as (select query_id, start_pos, end_pos, count(*) as n from h group by all) select * from n qualify n = max(n) over (partition by query_id)")
def most_frequent_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.most_frequent(V.HYPOTHESES.frame(spark, sf_dir), ["query_id"], ["start_pos", "end_pos"])


# --- reads --------------------------------------------------------------------

_O = lambda a, b: f"(a[{a}].ref_start < a[{b}].ref_end and a[{b}].ref_start < a[{a}].ref_end)"


def _router(al: str, again: str) -> str:
    """SQL of the read types; again: whether a row is one that the read maps to repeatedly."""
    return f"""
with al as {al},
g as (select query_id, list(struct_pack(query_start := query_start, query_end := query_end, ref_start := ref_start, ref_end := ref_end, chr := chr, strand := strand, exon_len := exon_len) order by query_start, query_end, ref_start, ref_end, chr, strand, exon_len) as a, count(*) as n, count(distinct chr) as nc, count(distinct chr || strand) as nl, bool_or({again}) as again from al group by 1 having count(*) >= 2),
r as (select query_id, a, n, nc, nl, again, list_transform(range(1, n), lambda i: (a[i].chr <> a[i + 1].chr)::int) as sw, list_sort(list_transform(range(1, n + 1), lambda i: row(-a[i].exon_len, i)))[1][2] as li from g),
o as (select *, list_transform(range(1, n + 1), lambda i: a[i].ref_start < a[li].ref_end and a[li].ref_start < a[i].ref_end) as ov from r),
p as (select *, list_sum(sw) as n_switch, list_sum(list_transform(ov, lambda x: x::int)) as hits, list_bool_and(list_transform(range(1, n), lambda i: ov[i] <> ov[i + 1])) as alt, list_min(sw) = 1 as calt,
  a[3].ref_start - a[1].ref_end > 40 and a[4].ref_start - a[2].ref_end > 40 and a[2].ref_end - a[1].ref_end > 40 and a[3].ref_end - a[2].ref_end > 40 and a[4].ref_end - a[3].ref_end > 40 and a[2].ref_start - a[1].ref_end > -40 and a[3].ref_start - a[2].ref_end > -40 and a[4].ref_start - a[3].ref_end > -40 as rg,
  a[3].query_start - a[1].query_end > 40 and a[4].query_start - a[2].query_end > 40 and a[2].query_end - a[1].query_end > 40 and a[3].query_end - a[2].query_end > 40 and a[4].query_end - a[3].query_end > 40 and a[2].query_start - a[1].query_end > -40 and a[3].query_start - a[2].query_end > -40 and a[4].query_start - a[3].query_end > -40 as qg from o)
select query_id, n as n_aln, nc as n_chr, n_switch::bigint as n_switch, list_min(list_transform(range(1, n), lambda i: abs(a[i + 1].query_start - a[i].query_end)))::bigint as min_gap, case when nc > 2 then 'multipleChrs'
 when nc = 2 then case when n_switch <= 1 then 'twoChrLowConf' when again then 'sameChrCandidate' when nl > 2 then 'twoChrsNotCandidate' when n >= 4 and calt and qg then 'twoChrsFusion' else 'twoChrsFusionLowConf' end
 when n = 2 then case when {_O(1, 2)} or again then 'sameChrCandidate' else 'sameChrNotCandidate' end
 when n = 3 and ({_O(1, 2)} or {_O(1, 3)}) and ({_O(3, 2)} or {_O(3, 1)}) then case when {_O(1, 2)} or again then 'sameChrCandidate' else 'sameChrFusionLowConf' end
 when n = 3 then case when again then 'sameChrCandidate' else 'sameChrLowConf' end when hits > n - 2 or again then 'sameChrCandidate' when not alt then 'sameChrLowConf' when rg then 'sameChrFusion' else 'sameChrFusionLowConf' end as read_type from p"""


@_query(_router(AL, "false"))
def read_type_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_types(V.ALIGNMENTS.frame(spark, sf_dir))


@_query(_router(AL, "ref_start % 7 = 0"))
def read_type_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_types(V.ALIGNMENTS.frame(spark, sf_dir), F.max(F.col("ref_start") % 7 == 0))


@_query(f"with a as {AL} select * from a qualify row_number() over (partition by query_id order by exon_len desc, query_start, chr, ref_start, ref_end, strand, query_end) = 1")
def read_top_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_alignment(V.ALIGNMENTS.frame(spark, sf_dir))


@_query(f"with a as {AL} select * from a qualify exon_len = max(exon_len) over (partition by query_id)")
def read_longest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.max_rows(V.ALIGNMENTS.frame(spark, sf_dir), ["query_id"], F.col("exon_len"))


@_query(f"""
with a as {AL}, m as (select query_id, ref_start, ref_end, max(ref_end) over (partition by query_id order by ref_start, ref_end rows between unbounded preceding and 1 preceding) as reach from a),
i as (select *, sum(case when reach is null or ref_start > reach then 1 else 0 end) over (partition by query_id order by ref_start, ref_end rows unbounded preceding) as k from m)
select query_id, min(ref_start) as union_start, max(ref_end) as union_end from i group by query_id, k""")
def merge_exon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.ALIGNMENTS.frame(spark, sf_dir)
    return R.merged_exons(a.select("query_id", F.col("ref_start").alias("exon_start"), F.col("ref_end").alias("exon_end")))


@_query(f"""
with x as {AX}, s as {RS},
j as (select x.*, s.strand, s.start_pos, s.end_pos from x join s using (query_id, chr) where abs(ref_start - start_pos) <= 300 and abs(ref_end - end_pos) <= 300),
b as (select * from j qualify n_exons = max(n_exons) over (partition by query_id)), c as (select * from b qualify exon_len = max(exon_len) over (partition by query_id)),
v as (select query_id, chr, strand, exon_no, case when exon_no = 0 then start_pos else exon_start + 1 end as s, case when exon_no = n_exons - 1 then end_pos else exon_end end as e, count(*) as n from c group by all)
select query_id, chr, strand, exon_no, s::bigint as exon_start, e::bigint as exon_end from (select * from v qualify row_number() over (partition by query_id, chr, strand, exon_no order by n desc, s, e) = 1) where e - s > 10""")
def isoform_exon_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.isoforms(V.ALN_EXONS.frame(spark, sf_dir), V.READ_SITES.frame(spark, sf_dir))


_FUSION = f"""
a as {AL}, n as (select *, row_number() over (partition by query_id order by query_start, query_end, ref_start, ref_end, chr, strand) as i, row_number() over (partition by query_id order by exon_len desc, query_start, query_end, ref_start, ref_end, chr desc) as l, min(chr) over (partition by query_id) <> max(chr) over (partition by query_id) as two from a),
s0 as (select n.*, case when n.two then n.chr = f.chr else n.ref_start < g.ref_end and g.ref_start < n.ref_end end as side0 from n join n f on n.query_id = f.query_id and f.i = 1 join n g on n.query_id = g.query_id and g.l = 1),
s as (select *, case when not two and bool_and(side0) over (partition by query_id) then i % 2 = 1 else side0 end as side from s0),
k as (select *, first_value(side) over (partition by query_id order by query_start, query_end, ref_start, ref_end, side) as s1 from s),
p as (select query_id, case when side = s1 then 1 else 2 end as locus, min(chr) as chr, min(ref_start) as "start", max(ref_end) as "end", count(*) as n, case when sum(case when strand = '+' then 1 else -1 end) >= 0 then '+' else '-' end as strand from k group by all),
w as (select x.query_id, x.chr as c1, x."start" as s1, x."end" as e1, x.strand as t1, x.n as n1, y.chr as c2, y."start" as s2, y."end" as e2, y.strand as t2, y.n as n2, x.chr = y.chr and y."start" < x."start" as sw from p x join p y on x.query_id = y.query_id and x.locus = 1 and y.locus = 2),
fp as (select query_id, {', '.join(f"case when sw then {a}{3 - i} else {a}{i} end as {n}_{i}" for i in (1, 2) for a, n in (('c', 'chr'), ('s', 'start'), ('e', 'end'), ('t', 'strand'), ('n', 'n')))} from w)"""


@_query(f"with {_FUSION} select * from fp")
def fusion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fusion_pairs(V.ALIGNMENTS.frame(spark, sf_dir))


@_query(f"with {_FUSION} select chr_1 || ':' || start_1 || '-' || end_1 || ':' || strand_1 || '|' || chr_2 || ':' || start_2 || '-' || end_2 || ':' || strand_2 as fusion_id, count(*) as n_reads, string_agg(query_id::varchar, ',' order by query_id) as read_ids from fp group by 1")
def fusion_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fusion_groups(R.fusion_pairs(V.ALIGNMENTS.frame(spark, sf_dir)))


#: Alignments of one exon, or of two where the span is long: its first and its last third.
_FA = f"(select *, case when ref_end - ref_start > 400 then [struct_pack(s := ref_start, e := ref_start + exon_len // 3), struct_pack(s := ref_end - exon_len // 3, e := ref_end)] else [struct_pack(s := ref_start, e := ref_end)] end as x from {AL})"
_GENOME = f"(select 'chr' || (id % 2 + 1) as chr, string_agg(seq, '' order by id) as seq from {SQ} group by 1)"


def _fusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.floor(F.col("exon_len") / 3)
    e = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    two = F.array(e(F.col("ref_start"), F.col("ref_start") + third), e(F.col("ref_end") - third, F.col("ref_end")))
    # dealt out by reads, so that rows are made distinct where their reads are dealt with
    rows = V.ALIGNMENTS.rows(spark, sf_dir).repartition("query_id").distinct()
    return rows.withColumn("exons", F.when(F.col("ref_end") - F.col("ref_start") > 400, two).otherwise(F.array(e(F.col("ref_start"), F.col("ref_end")))))


_FUSION_ROWS = _FUSION[: _FUSION.index("p as (select query_id, case when side")].rstrip().rstrip(",")
_SIDE = lambda i, n: ", ".join(f"{c}{i} as {f}_{n}" for c, f in (("c", "chr"), ("s", "start"), ("e", "end"), ("len", "len"), ("m", "exonNum"), ("xs", "exon_start"), ("xe", "exon_end"), ("l", "exon_leftSeq"), ("r", "exon_rightSeq"), ("t", "strand"), ("g", "geneName")))


@_query(f"""
with {_FUSION_ROWS},
fa as {_FA}, ge as {_GENOME}, gx as {E},
lo as (select k.query_id, case when side = s1 then 1 else 2 end as locus, k.chr, k.strand, k.exon_len, fa.x, len(fa.x) as m from k join fa on k.query_id = fa.query_id and k.chr = fa.chr and k.strand = fa.strand and k.ref_start = fa.ref_start and k.ref_end = fa.ref_end and k.query_start = fa.query_start and k.query_end = fa.query_end and k.exon_len = fa.exon_len),
b1 as (select * from lo qualify m = max(m) over (partition by query_id, locus)), b2 as (select * from b1 qualify exon_len = max(exon_len) over (partition by query_id, locus)),
st as (select query_id, locus, min(chr) as chr, case when sum(case when strand = '+' then 1 else -1 end) >= 0 then '+' else '-' end as strand from b2 group by all),
ex as (select query_id, locus, j, x[j].s as s, x[j].e as e from (select *, unnest(range(1, m + 1)) as j from b2)),
vo as (select query_id, locus, j, s, e from (select *, count(*) as n from ex group by all) qualify row_number() over (partition by query_id, locus, j order by n desc, s, e) = 1),
vk as (select vo.*, chr, strand, min(j) over w as j0, max(j) over w as j1 from vo join st using (query_id, locus) where e - s > 10 window w as (partition by query_id, locus)),
kd as (select distinct chr, strand, s, e from vk),
ns as (select kd.*, gene_id, min(row(abs(start_pos - s), start_pos)) as d from kd join gx using (chr, strand) where abs(start_pos - s) <= 14 group by all),
ne as (select kd.*, gene_id, min(row(abs(end_pos - e), end_pos)) as d from kd join gx using (chr, strand) where abs(end_pos - e) <= 14 group by all),
sn as (select chr, strand, s, e, ns.d[2] as s2, ne.d[2] as e2 from ns join ne using (chr, strand, s, e, gene_id) qualify row_number() over (partition by chr, strand, s, e order by ns.d[1] + ne.d[1], gene_id) = 1),
xx as (select query_id, locus, chr, strand, case when j = j0 then s else coalesce(s2, s) end as s, case when j = j1 then e else coalesce(e2, e) end as e from vk left join sn using (chr, strand, s, e)),
xj as (select *, row_number() over (partition by query_id, locus order by s, e) as j from xx),
gs as (select distinct x.chr, x.strand, x.s, x.e, gene_id from (select distinct chr, strand, s, e from xj) x join gx using (chr, strand) where abs(start_pos - s) <= 14),
gn as (select distinct x.chr, x.strand, x.s, x.e, gene_id from (select distinct chr, strand, s, e from xj) x join gx using (chr, strand) where abs(end_pos - e) <= 14),
gb as (select * from gs join gn using (chr, strand, s, e, gene_id)),
gg as (select query_id, locus, string_agg(distinct gene_id, ',' order by gene_id) as g from xj join gb using (chr, strand, s, e) group by all),
fq as (select xj.*, case when seq is null then '' when s - 2 < 0 or s > length(seq) then 'NA' else substring(seq, s - 1, 2) end as l, case when seq is null then '' when e + 2 > length(seq) then 'NA' else substring(seq, e + 1, 2) end as r from xj left join ge using (chr)),
lc as (select query_id, locus, chr as c, strand as t, min(s) as s, max(e) filter (j = n) as e, sum(e - s + 1)::bigint as len, count(*) as m, string_agg(s::varchar, ',' order by j) as xs, string_agg(e::varchar, ',' order by j) as xe, string_agg(l, ',' order by j) as l, string_agg(r, ',' order by j) as r, string_agg(s || '-' || e, ',' order by j) as txt
  from (select *, count(*) over (partition by query_id, locus) as n from fq) group by query_id, locus, chr, strand),
lg as (select lc.*, coalesce(g, 'intergenic') as g, count(*) over (partition by query_id) as loci, row_number() over (partition by query_id order by case when cmin = cmax then s end, locus) as side from (select *, min(c) over (partition by query_id) as cmin, max(c) over (partition by query_id) as cmax from lc) lc left join gg using (query_id, locus)),
pr as (select {', '.join(f"{v}.{f} as {f}{i}" for i, v in ((1, "a"), (2, "b")) for f in ("c", "s", "e", "len", "m", "xs", "xe", "l", "r", "t", "g", "txt"))}, a.query_id from lg a join lg b on a.query_id = b.query_id and a.side = 1 and b.side = 2 where a.loci = 2),
pi as (select *, c1 || ':' || s1 || '-' || e1 || ':' || t1 || '|' || c2 || ':' || s2 || '-' || e2 || ':' || t2 as cid, c1 || ':' || txt1 || ':' || t1 || '|' || c2 || ':' || txt2 || ':' || t2 as iid from pr),
pn as (select *, count(*) over (partition by iid) as n, string_agg(query_id::varchar, ',') over (partition by iid order by query_id rows between unbounded preceding and unbounded following) as ids, row_number() over (partition by iid order by query_id) as rn from pi)
select cid as "circID", iid as "isoID", {_SIDE(1, "first")}, {_SIDE(2, "second")}, n as "readCount", ids as "readID" from pn where rn = 1""")
def fusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fusion table of the alignments, with the customers' bases as the genome."""
    from ringloom.plans.calling import fetched

    s = V.SEQUENCES.frame(spark, sf_dir)
    chrom = F.concat(F.lit("chr"), (F.col("id") % 2 + 1).cast("string"))
    genome = s.groupBy(chrom.alias("chr")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    gtf = V.EXONS.rows(spark, sf_dir)
    return I.fusion_table(I.fusion_structure(_fusion_rows(spark, sf_dir), gtf), gtf, lambda d, at, name: fetched(d, F.col(at), genome, name))


#: Isoforms of two exons, whose inner bounds vary by some bases.
_ISO = f"(select query_id, chr, strand, start_pos, end_pos, [struct_pack(s := start_pos, e := start_pos + 60 + (query_id % 7) * (query_id % 5)), struct_pack(s := end_pos - 70 + query_id % 4 * 5, e := end_pos)] as x from {SI})"


def _isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    q = F.col("query_id")
    exons = F.array(e(F.col("start_pos"), F.col("start_pos") + 60 + (q % 7) * (q % 5)), e(F.col("end_pos") - 70 + q % 4 * 5, F.col("end_pos")))
    return V.SITES.frame(spark, sf_dir).withColumn("exons", exons).select("query_id", "chr", "strand", "start_pos", "end_pos", "exons")


@_query(f"""
with i as {_ISO}, k as (select chr, strand, start_pos, end_pos, x, count(*) as n from i group by all), z as (select chr, strand, start_pos, end_pos, x, n, j, x[j].s as s, x[j].e as e from (select *, unnest([1, 2]) as j from k)),
a as (select z.chr, z.strand, z.start_pos, z.end_pos, z.x, z.j, min(row(abs(h.s - z.s), h.s)) filter (abs(h.s - z.s) < 14) as ns, min(row(abs(h.e - z.e), h.e)) filter (abs(h.e - z.e) < 14) as ne, any_value(z.s) as s, any_value(z.e) as e
  from z left join z h on h.n > 1 and z.chr = h.chr and z.strand = h.strand and z.start_pos = h.start_pos and z.end_pos = h.end_pos and z.j = h.j where z.n = 1 group by z.chr, z.strand, z.start_pos, z.end_pos, z.x, z.j),
t as (select chr, strand, start_pos, end_pos, x, string_agg(coalesce(ns[2], s) || '-' || coalesce(ne[2], e), ',' order by j) as txt from a group by all)
select query_id, coalesce(txt, x[1].s || '-' || x[1].e || ',' || x[2].s || '-' || x[2].e) as exon_text from i left join t using (chr, strand, start_pos, end_pos, x)""")
def isoform_low_to_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.to_confident(_isoforms(spark, sf_dir)).select("query_id", S.exon_text(F.col("exons")).alias("exon_text"))


@_query()
def isoform_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.absorb_bounds(_isoforms(spark, sf_dir)).select("query_id", S.exon_text(F.col("exons")).alias("exon_text"))


# --- annotation ----------------------------------------------------------------


@_query(f"with e as {E} select chr, gene_id, strand, min(start_pos) as gene_start, max(end_pos) as gene_end, null::varchar as gene_name from e group by chr, gene_id, strand")
def gene_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gene_extents(V.EXONS.frame(spark, sf_dir))


@_query(f"with e as {E}, d as (select distinct chr, gene_id, strand, transcript_id, start_pos, end_pos from e) select transcript_id, strand, count(*)::int as n_exons, sum(end_pos - start_pos + 1)::bigint as len, string_agg(start_pos || '-' || end_pos, ',' order by start_pos, end_pos) as exon_text from d group by chr, gene_id, strand, transcript_id")
def transcript_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.transcripts(V.EXONS.frame(spark, sf_dir))
    return t.select("transcript_id", "strand", F.size("exons").alias("n_exons"), S.exon_length(F.col("exons")).alias("len"), S.exon_text(F.col("exons")).alias("exon_text"))


#: Circles of two exons: the first and the last third of a candidate's span.
_PARTS = "(select query_id, chr, unnest([start_pos, end_pos - (end_pos - start_pos) // 3]) as c_start, unnest([start_pos + (end_pos - start_pos) // 3, end_pos]) as c_end from c)"


@_query(f"""
with c as {C}, e as {E}, x as {_PARTS},
g as (select chr, gene_id, strand as gs, min(start_pos) - 40 as lo, max(end_pos) + 40 as hi from e group by all),
p as (select c.query_id, c.chr, c.strand, c.start_pos, c.end_pos, g.gene_id, gs, c.start_pos >= lo and c.end_pos <= hi as held from c join g on c.chr = g.chr and c.strand = gs and c.end_pos >= lo and c.start_pos <= hi),
b as (select distinct chr, gene_id, start_pos as xs, end_pos as xe from e),
fs as (select c.query_id, gene_id, bool_or(abs(start_pos - xs) <= 14) as ss, bool_or(abs(start_pos - xe) <= 14) as se, bool_or(start_pos between xs - 10 and xe + 10) as si from c join b on c.chr = b.chr and c.start_pos between xs - 14 and xe + 14 group by all),
fe as (select c.query_id, gene_id, bool_or(abs(end_pos - xe) <= 14) as ee, bool_or(abs(end_pos - xs) <= 14) as es, bool_or(end_pos between xs - 10 and xe + 10) as ei from c join b on c.chr = b.chr and c.end_pos between xs - 14 and xe + 14 group by all),
h as (select query_id, gene_id, c_start, c_end, max((abs(c_start - xs) <= 14)::int) + max((abs(c_end - xe) <= 14)::int) + max((abs(c_start - xe) <= 14)::int) + max((abs(c_end - xs) <= 14)::int) as hits from x join b on x.chr = b.chr and c_start <= xe + 14 and c_end >= xs - 14 group by all),
hs as (select query_id, gene_id, sum(hits) as hits from h group by all),
o as (select query_id, gene_id, sum(1 + least(c_end, end_pos) - greatest(c_start, start_pos)) as cover from x join e on x.chr = e.chr and c_start < end_pos and c_end > start_pos where least(c_end, end_pos) > greatest(c_start, start_pos) group by all),
s as (select p.*, 1000 + 10 * coalesce(hits, 0) + coalesce(cover, 0) as score, coalesce(ss and ee, false) or coalesce(se and es, false) or coalesce(si and ei, false) as exonic
  from p left join fs using (query_id, gene_id) left join fe using (query_id, gene_id) left join hs using (query_id, gene_id) left join o using (query_id, gene_id)),
w as (select query_id, gene_id, score, bool_or(exonic) over (partition by query_id) as exonic, bool_or(held) over (partition by query_id) as held from s qualify row_number() over (partition by query_id order by score desc, gene_id) = 1),
t as (select w.query_id, c_start, c_end, transcript_id, start_pos as xs, end_pos as xe, least(c_end, end_pos) - greatest(c_start, start_pos) as wd, abs(c_start - start_pos) <= 10 and abs(c_end - end_pos) <= 10 as exact from w join x using (query_id) join e using (gene_id)),
u as (select *, min(case when exact then row(xs, xe) end) over (partition by query_id, c_start, c_end, transcript_id) as stop from t where exact or wd > 0),
v as (select query_id, transcript_id, sum(case when row(xs, xe) = stop then 20 when wd > 0 and (stop is null or row(xs, xe) < stop) then 1 + wd // 10 else 0 end) as ts from u group by all),
n as (select w.query_id, a.transcript_id from w join (select distinct gene_id, transcript_id from e) a using (gene_id) left join v on v.query_id = w.query_id and v.transcript_id = a.transcript_id qualify row_number() over (partition by w.query_id order by coalesce(ts, 0) desc, a.transcript_id) = 1)
select c.query_id as circ_key, case when exonic then 'exon' when held then 'intron' else 'intergenic_region' end as circ_type, gene_id as host_gene, score::bigint as gene_score, transcript_id as best_transcript from c left join w using (query_id) left join n using (query_id)""")
def gene_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.CANDS.frame(spark, sf_dir).withColumnRenamed("query_id", "circ_key")
    third = F.floor((F.col("end_pos") - F.col("start_pos")) / 3)
    both = F.array(F.struct(F.col("start_pos").alias("s"), (F.col("start_pos") + third).alias("e")), F.struct((F.col("end_pos") - third).alias("s"), F.col("end_pos").alias("e")))
    x = c.select("circ_key", F.explode(both).alias("x")).select("circ_key", F.col("x.s").alias("c_start"), F.col("x.e").alias("c_end"))
    return A.annotate(c, x, V.EXONS.rows(spark, sf_dir))


_ID = "chr || ':' || start_pos || '-' || end_pos || ':' || strand"


@_query(f"with s as {SI}, d as (select query_id, 'circ' || chr || '(' || start_pos // 300 || ')' as uniform_id, {_ID} as circ_id from s) select query_id, uniform_id, circ_id, uniform_id || '.' || dense_rank() over (partition by uniform_id order by circ_id) as final_name from d")
def uniform_name_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SITES.frame(spark, sf_dir).withColumn("uniform_id", F.concat(F.lit("circ"), "chr", F.lit("("), F.floor(F.col("start_pos") / 300).cast("string"), F.lit(")")))
    return A.ranked_names(s, "uniform_id").select("query_id", "uniform_id", "circ_id", "final_name")


_SNAP = f"""c as {C}, e as {E},
sn as (select query_id, gene_id, min(row(abs(e.start_pos - c.start_pos), e.start_pos)) as s from c join e on c.chr = e.chr and c.strand = e.strand and abs(e.start_pos - c.start_pos) <= 40 group by all),
en as (select query_id, gene_id, min(row(abs(e.end_pos - c.end_pos), e.end_pos)) as t from c join e on c.chr = e.chr and c.strand = e.strand and abs(e.end_pos - c.end_pos) <= 40 group by all),
k as (select query_id, c.chr, c.strand, gene_id, s[2] as cs, t[2] as ce from sn join en using (query_id, gene_id) join c using (query_id) qualify row_number() over (partition by query_id order by s[1] + t[1], gene_id) = 1)"""


@_query(f"""
with {_SNAP},
x as (select transcript_id, gene_id, start_pos as xs, end_pos as xe, row_number() over t as i, count(*) over (partition by transcript_id) as n, lead(start_pos) over t as nxt from (select distinct transcript_id, gene_id, start_pos, end_pos from e) window t as (partition by transcript_id order by start_pos, end_pos)),
m as (select k.*, x.*, least(ce, xe) - greatest(cs, xs) as w from k join x using (gene_id)),
b as (select * from m where w > 0 qualify row_number() over (partition by query_id, transcript_id order by w desc, i) = 1),
r as (select distinct query_id, transcript_id from m where nxt is not null and xe + 1 < nxt and abs(cs - xe - 1) <= 10 and abs(ce - nxt + 1) <= 10),
z as (select query_id, transcript_id, case when strand = '+' then case when ce - xe > 10 then 'L' else '' end || i || case when cs - xs > 10 then 'S' else '' end else case when xs - cs > 10 then 'L' else '' end || (n - i + 1) || case when xe - ce > 10 then 'S' else '' end end as token from b)
select a.query_id, a.transcript_id, 'circ' || gene_id || '(' || coalesce(z.token, case when r.query_id is not null then 'RI' else 'NE' end) || ')' as uniform_id
from (select distinct query_id, transcript_id, gene_id from m) a left join z using (query_id, transcript_id) left join r using (query_id, transcript_id)""")
def exon_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = V.EXONS.rows(spark, sf_dir)
    return A.exon_names(J.snap_to_genes(V.CANDS.frame(spark, sf_dir), exons), exons)


# --- molecules -----------------------------------------------------------------


@_query(f"""
with m as {MO}, n as (select cluster_id, circ_id, isoform_id, count(*) as n from m where cluster_id <> '' group by all),
t as (select * from n qualify row_number() over (partition by cluster_id order by n desc, circ_id, isoform_id) = 1),
i as (select circ_id, isoform_id, count(*) as n_umi from t group by all), s as (select *, (sum(n_umi) over (partition by circ_id))::bigint as circ_umi from i)
select circ_id, isoform_id, n_umi, circ_umi, n_umi >= 2 as confident from s where circ_umi >= 2""")
def umi_vote_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.vote_clusters(V.MOLECULES.frame(spark, sf_dir))


@_query(f"""
with m as {MO}, s as {SQ}, r as (select read_id, cluster_id, s.seq from m join s on s.id = m.read_id where cluster_id <> ''),
p as (select read_id, cluster_id, unnest([substring(seq, 1, 20), substring(seq, 21, 20), substring(seq, 41, 24)]) as segment from r)
select cluster_id, count(distinct read_id) as n_reads, count(*) as n_segments, sum(length(segment))::bigint as n_bases from p group by 1""")
def ccs_umi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir).select(F.col("id").alias("read_id"), S.segments_of(F.lit("0-20;20-40;40-64"), F.col("seq")).alias("segments"))
    return M.molecule_segments(s, V.MOLECULES.frame(spark, sf_dir).where("cluster_id <> ''").select("read_id", "cluster_id"))


@_query(f"""
with m as {MO}, r as (select *, row_number() over (partition by rep order by md5(read_id || '_' || rep), read_id) as i from m, range(3) t(rep)),
z as (select unnest([500, 1000, 2000, 4000]) as sample_size)
select sample_size, rep::int as rep, sum(len)::bigint as total_len, count(distinct circ_id) as n_circ from r, z where i <= sample_size group by all""")
def saturation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.saturation(V.MOLECULES.frame(spark, sf_dir), (500, 1000, 2000, 4000), 3)


@_query(f"""
with m as {MO}, c as (select event_id as read_id, 'u' || event_id % 11 as cluster_id from events where event_id % 3 = 0)
select m.read_id, circ_id, coalesce(c.cluster_id, '') as cluster_id from m left join c using (read_id)""")
def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.MOLECULES.frame(spark, sf_dir).drop("cluster_id")
    c = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0").selectExpr("event_id as read_id", "concat('u', cast(event_id % 11 as string)) as cluster_id")
    return M.with_clusters(m, c).select("read_id", "circ_id", "cluster_id")


@_query(f"with s as (select repeat(seq, (id % 5 + 1)::int) as seq from {SQ}), l as (select length(seq)::bigint as len, count(*) as m from s group by 1), r as (select *, sum(len * m) over (order by len desc) as run, sum(len * m) over () as t from l) select sum(m)::bigint as n, max(t)::bigint as total, max(len) filter (2 * run >= t) as n50 from r")
def sequence_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    return M.n50(s.select(F.repeat("seq", (F.col("id") % 5 + 1).cast("int")).alias("seq")))


@_query(f"with s as (select id, regexp_replace(seq, '(A+|C+|G+|T+)', '\\1 ', 'g') as p from {SQ}), l as (select id, list_transform(list_filter(string_split(p, ' '), lambda x: x <> ''), lambda x: x[1]) as h from s), k as (select array_to_string(h[i:i+5], '') as kmer from (select h, unnest(range(1, len(h) - 4)) as i from l)) select kmer, count(*) as n from k group by 1")
def kmer_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.skipping_kmers(V.SEQUENCES.frame(spark, sf_dir), 6, True).groupBy("kmer").agg(F.count("*").alias("n"))


@_query(f"with s as {SQ}, w as (select id, substring(seq, 1, 11) as a, substring(seq, 12, 11) as b from s) select id, least(levenshtein(a, b), 3)::int as distance from w")
def bounded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    return s.select("id", S.bounded_distance(F.substring("seq", 1, 11), F.substring("seq", 12, 11)).alias("distance"))


@_query(f"with s as {SQ}, k as (select substring(seq, i, 6) as kmer from (select seq, unnest(range(1, length(seq) - 4)) as i from s)) select kmer, count(*) as n from k group by 1")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kmers(V.SEQUENCES.frame(spark, sf_dir), 6).groupBy("kmer").agg(F.count("*").alias("n"))


@_query(f"""
with s as {SQ}, k as (select id, substring(seq, i, 6) as kmer, count(*) as n from (select id, seq, unnest(range(1, length(seq) - 4)) as i from s) group by all)
select x.id as a, y.id as b, sum(least(x.n, y.n))::bigint as shared from k x join k y on x.kmer = y.kmer and x.id < y.id group by all having sum(least(x.n, y.n)) >= 5""")
def shared_word_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.shared_words(V.SEQUENCES.frame(spark, sf_dir), 6, 5)


_GAPS = "select l_partkey % 300 as grp, (l_suppkey % 30) * 2 + l_linenumber as gap from lineitem"


@_query(f"""
with v as ({_GAPS}), c as (select grp, gap, count(*) as n from v group by all), s as (select grp, sum(n) as total from c group by 1),
d as (select x.grp, x.gap, x.n, round(sum(y.n * exp(-0.5 * pow((x.gap - y.gap) / pow(total::double, -0.2), 2))), 9) as density from c x join c y using (grp) join s using (grp) group by all)
select grp, gap as peak, n as support, density from d qualify row_number() over (partition by grp order by density desc, gap) = 1""")
def kde_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey % 300 as grp", "(l_suppkey % 30) * 2 + l_linenumber as gap")
    return M.kde_peak(v, "grp", "gap")


# --- scalar functions -----------------------------------------------------------


@_query(f"with s as {SQ} select id, {_RC.format('seq')} as rc, length(seq)::int as len, repeat(seq, 3) as tripled from s")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.SEQUENCES.frame(spark, sf_dir).select("id", S.revcomp(F.col("seq")).alias("rc"), F.length("seq").alias("len"), F.repeat("seq", 3).alias("tripled"))


@_query(f"""
with s as {SQ}, m as (select * from (values {', '.join(f"('{c}', {m})" for c, m in S.IUPAC.items())}) v(c, m))
select id, i as pos, x.m & y.m <> 0 as hit from (select id, i, substring(seq, i, 1) as b, substring('{K.PATTERN}', i, 1) as p from s, (select unnest(range(1, 25))::int as i)) join m x on x.c = b join m y on y.c = p""")
def iupac_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.SEQUENCES.frame(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(24))))
    at = lambda s: F.substring(s, F.col("pos"), F.lit(1))
    return d.select("id", "pos", S.iupac_match(at(F.col("seq")), at(F.lit(K.PATTERN))).alias("hit"))


@_query(f"with s as {SQ} select a.id, levenshtein(a.seq, b.seq)::int as distance from s a join s b on b.id = a.id + 1")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    t = s.select((F.col("id") - 1).alias("id"), F.col("seq").alias("other"))
    return s.join(t, "id").select("id", F.levenshtein("seq", "other").alias("distance"))


_CIGAR = "concat(cast(l_linenumber % 3 as string), 'S', cast(l_suppkey % 50 + 1 as string), 'M', cast(l_partkey % 9 + 1 as string), 'I', cast(l_suppkey % 7 + 1 as string), 'M', cast(l_partkey % 300 + 20 as string), 'N', cast(l_linenumber + 10 as string), 'M', cast(l_suppkey % 5 + 1 as string), 'D4M6H') as cigar"
CIGARS = V.View("lineitem", ("l_orderkey as query_id", "cast(l_linenumber as bigint) as line", "l_partkey as part", "l_suppkey as supp", "cast(floor(l_extendedprice) as bigint) as ref_begin", _CIGAR), "true", True)


@_query(f"""
with v as {CIGARS.sql}, o as (select query_id, line, part, supp, ref_begin, cigar, unnest(range(1, len(n) + 1)) as i, n, k from (select *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) as n, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) as k from v)),
s as (select *, n[i]::bigint as z, k[i] as c from o),
r as (select *, ref_begin + coalesce(sum(case when c in ('M','=','X','D','N') then z else 0 end) over (partition by query_id, line, part, supp, ref_begin, cigar order by i rows between unbounded preceding and 1 preceding), 0) as pos, sum(case when c = 'N' then 1 else 0 end) over (partition by query_id, line, part, supp, ref_begin, cigar order by i) as b from s),
e as (select query_id, line, part, supp, ref_begin, cigar, b, min(pos) as s, max(pos + z) as t from r where c in ('M','=','X','D') group by all),
q as (select query_id, line, part, supp, ref_begin, cigar, sum(case when c in ('S','H') and i = 1 then z else 0 end)::bigint as query_start, sum(case when c in ('S','H') and i = 1 or c in ('M','I','=','X') then z else 0 end)::bigint as query_end from s group by all)
select query_id, line, part, supp, ref_begin, string_agg(s::bigint || '-' || t::bigint, ',' order by s) as exons, any_value(query_start) as query_start, any_value(query_end) as query_end from e join q using (query_id, line, part, supp, ref_begin, cigar) group by query_id, line, part, supp, ref_begin, cigar""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text follows from the other columns, so rows are made distinct without it
    d = CIGARS._replace(columns=CIGARS.columns[:-1]).frame(spark, sf_dir)
    text = _CIGAR.replace("l_linenumber", "line").replace("l_suppkey", "supp").replace("l_partkey", "part")
    d = d.selectExpr("*", text).withColumn("b", S.cigar_blocks(F.col("cigar"), F.col("ref_begin")))
    return d.select("query_id", "line", "part", "supp", "ref_begin", S.exon_text(F.col("b.exons")).alias("exons"), "b.query_start", "b.query_end")


@_query(f"""
with s as {SI}, k as (select {_ID} as cid, chr, strand, start_pos, end_pos, count(*) as n from s group by all having count(*) >= 2)
select cid as circ_id, 0 as ord, concat_ws(chr(9), k.chr, 'ringloom', 'BSJ', start_pos::varchar, end_pos::varchar, n::varchar, strand, '.', 'circ_id "' || cid || '";') as line from k
union all select cid, 1, concat_ws(chr(9), k.chr, 'ringloom', 'transcript', start_pos::varchar, end_pos::varchar, n::varchar, strand, '.', 'circ_id "' || cid || '"; transcript_id "' || cid || '|' || start_pos || '-' || end_pos || '";') from k
union all select cid, 2, concat_ws(chr(9), k.chr, 'ringloom', 'exon', start_pos::varchar, end_pos::varchar, '.', strand, '.', 'circ_id "' || cid || '"; transcript_id "' || cid || '|' || start_pos || '-' || end_pos || '"; exon_number 1;') from k""")
def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SITES.frame(spark, sf_dir).withColumn("exons", F.array(F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))))
    return sinks.gtf_lines(s, 2).select("circ_id", "ord", "line")


# --- kernels ---------------------------------------------------------------------

ANCHOR = "AAGCAGTGGTATCAACGCAGAGTAC"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule's read: the customer's bases thrice, behind an anchor and a UMI."""
    s = V.SEQUENCES.frame(spark, sf_dir)
    umi = F.concat(F.lit("CTC"), F.substring("seq", 1, 3), F.lit("CA"), F.substring("seq", 4, 3), F.lit("TG"), F.substring("seq", 7, 3), F.lit("CA"), F.substring("seq", 10, 3), F.lit("GAG"))
    return s.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read_id"), F.concat(F.lit(ANCHOR), umi, F.repeat("seq", 4)).alias("seq"))


@_query()
def umi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.umi_reads(_reads(spark, sf_dir), ANCHOR)


@_query()
def umi_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    return M.cluster_umis(s.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read_id"), "seq"))


@_query()
def tandem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    return K.ccs_reads(s.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read_id"), F.repeat("seq", 4).alias("seq")))


@_query()
def poa_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    part = s.select((F.col("id") % 50).alias("cluster_id"), F.col("id").alias("ord"), "seq")
    return K.consensus_by(part, "cluster_id")


@_query()
def minimizer_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.SEQUENCES.frame(spark, sf_dir)
    return K.remap_flags(s.select(F.col("id").alias("query_id"), F.repeat("seq", 4).alias("seq"), F.concat("seq", F.repeat(S.revcomp(F.col("seq")), 1)).alias("ref")))
