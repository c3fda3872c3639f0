"""Read- and annotation-shaped views over the star-schema tables.

A view's columns are expressions that Spark and DuckDB read alike, so each view
has one definition for both."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class View(NamedTuple):
    table: str
    columns: tuple[str, ...]
    where: str = "true"
    distinct: bool = False

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The view before ``distinct``, for operators that take its rows as a set."""
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where).selectExpr(*self.columns)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        d = self.rows(spark, sf_dir)
        return d.distinct() if self.distinct else d

    @property
    def sql(self) -> str:
        return f"(select {'distinct ' * self.distinct}{', '.join(self.columns)} from {self.table} where {self.where})"


def dna(x: str) -> str:
    """64 bases made from the hash of an expression."""
    return f"translate(concat(md5({x}), md5(concat({x}, '_'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


_GENE = "(l_partkey % 200)"
_S = "cast(floor(l_extendedprice) as bigint)"
EXONS = View("lineitem", (
    f"concat('G', cast({_GENE} as string)) as gene_id", f"concat('chr', cast({_GENE} % 5 + 1 as string)) as chr", f"case when {_GENE} % 2 = 0 then '+' else '-' end as strand",
    f"concat('T', cast({_GENE} as string), '.', cast(l_suppkey % 3 as string)) as transcript_id", f"{_S} as start_pos", f"{_S} + cast(floor(l_quantity) as bigint) * 4 as end_pos",
), "true", True)
_P = "cast(floor(o_totalprice / 5) as bigint)"
CANDS = View("orders", (
    "o_orderkey as query_id", "concat('chr', cast(o_custkey % 5 + 1 as string)) as chr", "case when o_orderstatus = 'O' then '+' else '-' end as strand",
    f"{_P} as start_pos", f"{_P} + (o_custkey % 50) * 4 + 1 as end_pos",
))
#: Coarser positions, so that sites repeat; flanks made from the customer.
_Q = "(cast(floor(o_totalprice / 500) as bigint) * 30 + o_custkey % 3)"
SITES = View("orders", (
    "o_orderkey as query_id", "concat('chr', cast(o_custkey % 5 + 1 as string)) as chr", "case when o_orderstatus = 'O' then '+' else '-' end as strand",
    f"{_Q} as start_pos", f"{_Q} + 200 + (o_orderkey % 2) * 7 as end_pos", "o_custkey % 3 <> 0 as left_ok", "o_orderkey % 3 <> 0 as right_ok",
))
HYPOTHESES = View("orders", (
    "o_custkey as query_id", "concat('chr', cast(o_custkey % 5 + 1 as string)) as chr", "case when o_orderstatus = 'O' then '+' else '-' end as strand",
    "(o_orderkey % 3) * 50 + 100 as start_pos", "(o_orderkey % 3) * 50 + 300 + (o_orderkey % 5) * 10 as end_pos",
    "substring(translate(md5(cast(o_orderkey % 3 + o_custkey as string)), '0123456789abcdef', 'AGCTAGGTACACAGAT'), 1, 2) as left_seq",
    "substring(translate(md5(cast(o_orderkey % 5 + o_custkey as string)), '0123456789abcdef', 'AGCTAGGTACACAGAT'), 3, 2) as right_seq",
))
_R = "cast(floor(l_extendedprice / 20) as bigint)"
ALIGNMENTS = View("lineitem", (
    "l_orderkey as query_id", "concat('chr', cast(l_suppkey % 2 + 1 as string)) as chr", "case when l_returnflag = 'N' then '+' else '-' end as strand",
    f"{_R} as ref_start", f"{_R} + 50 + cast(floor(l_quantity) as bigint) * 20 as ref_end",
    "cast(l_linenumber as bigint) * 100 as query_start", "cast(l_linenumber as bigint) * 100 + 60 + cast(floor(l_quantity) as bigint) as query_end", "50 + cast(floor(l_quantity) as bigint) * 20 as exon_len",
), "true", True)
ALN_EXONS = View("lineitem", (
    "l_orderkey as query_id", "concat('chr', cast(l_orderkey % 2 + 1 as string)) as chr",
    "1000 + l_partkey % 30 as ref_start", "2000 + l_partkey % 40 as ref_end", "cast(l_suppkey % 2 + 2 as bigint) as n_exons", "900 + l_partkey % 2 as exon_len",
    "cast((l_linenumber - 1) % (l_suppkey % 2 + 2) as bigint) as exon_no", "1000 + ((l_linenumber - 1) % (l_suppkey % 2 + 2)) * 300 + l_partkey % 3 as exon_start", "1000 + ((l_linenumber - 1) % (l_suppkey % 2 + 2)) * 300 + (l_partkey % 4) * 5 + l_suppkey % 90 as exon_end",
))
READ_SITES = View("orders", (
    "o_orderkey as query_id", "concat('chr', cast(o_orderkey % 2 + 1 as string)) as chr", "case when o_orderstatus = 'O' then '+' else '-' end as strand",
    "1000 + o_custkey % 20 as start_pos", "2000 + o_custkey % 20 as end_pos",
))
MOLECULES = View("events", (
    "event_id as read_id", "case when user_id % 7 = 0 then '' else concat('c', cast(user_id as string), '_', cast(event_id % 5 as string)) end as cluster_id", "concat('circ', cast(event_id % 37 as string)) as circ_id",
    "concat(event_type, '.', cast(event_id % 37 as string)) as isoform_id", "cast(floor(value) as bigint) + 100 as len",
))
SEQUENCES = View("customer", ("c_custkey as id", f"{dna('c_name')} as seq"))
