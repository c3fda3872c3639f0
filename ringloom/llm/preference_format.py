"""Preference formatting (SQL functions only).

A pair is a chosen and a rejected conversation. The longest common prefix of
their turns (equal role and equal text) is rendered once, as the prompt; what
follows on each side is that side's completion. Completions are masked: a loss
counts only on spans of assistant turns, that is their text and closing mark.
Spans are given as code-point offsets ``start-end`` into the completion.

A turn renders as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed.
``<|`` within roles and texts becomes ``< |``, so that no text can forge a mark.

Repeated rows of one (conversation, turn) merge map-side into one turn, the
least by (role, text), before a conversation's turns meet in its row. Defined
results: null role or text is empty; rows with a null conversation or turn go; a pair
of one side has an empty completion on the other and no common turns; equal sides
have two empty completions; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOSEN, REJECTED = 0, 1


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _spans(turns: Column, learn: str) -> Column:
    """start-end of each learnt span, comma-joined."""
    head = lambda t: F.length(F.concat(F.lit("<|"), F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("|>\n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t["shown"])
        own = F.concat_ws("-", acc["at"] + head(t), end - 1)  # all but the last line feed
        return F.struct(end.alias("at"), F.when(t["role"] == learn, F.array_append(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_preferences(turns: DataFrame, pair: Column, side: Column, learn: str = "assistant") -> DataFrame:
    """turns: rows (conv_id, turn, role, text); pair: the pair's id; side: CHOSEN
    or REJECTED. One row per pair: pair_id, chosen_id, rejected_id, n_common,
    n_chosen, n_rejected, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", pair.cast("long").alias("pair_id"), side.cast("int").alias("side"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    one = rows.groupBy("pair_id", "side", "conv_id", "turn").agg(F.min("t").alias("t"))
    met = one.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "side", "conv_id", F.col("t.role").alias("role"), F.col("t.text").alias("text"), _render(F.col("t.role"), F.col("t.text")).alias("shown")))).alias("all"))
    pick = lambda n: F.filter("all", lambda t: t["side"] == n)
    met = met.select("pair_id", pick(CHOSEN).alias("c"), pick(REJECTED).alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    differ = lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])
    first = F.array_min(F.filter(F.when(short > 0, F.sequence(F.lit(0), short - 1)), differ))
    met = met.withColumn("n", F.coalesce(first, short))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    met = met.select("pair_id", F.get("c", F.lit(0))["conv_id"].alias("chosen_id"), F.get("r", F.lit(0))["conv_id"].alias("rejected_id"), "n", F.when(F.col("n") > 0, F.slice("c", 1, F.col("n"))).alias("p"), F.when(F.size("c") > F.col("n"), rest("c")).alias("c"), F.when(F.size("r") > F.col("n"), rest("r")).alias("r"))
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda t: t["shown"]), ""), F.lit(""))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return met.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_common"), F.greatest(count("c"), F.lit(0)).cast("long").alias("n_chosen"), F.greatest(count("r"), F.lit(0)).cast("long").alias("n_rejected"),
        shown("p").alias("prompt"), shown("c").alias("chosen"), shown("r").alias("rejected"),
        F.coalesce(_spans(F.col("c"), learn), F.lit("")).alias("chosen_spans"), F.coalesce(_spans(F.col("r"), learn), F.lit("")).alias("rejected_spans"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """The pairs of the conversations table: conversations 2k (chosen) and 2k + 1 (rejected)."""
    conv = F.col("conv_id")
    return format_preferences(turns, F.floor(conv / 2), F.pmod(conv, F.lit(2)))


def neighbours_sql(learn: str = "assistant") -> str:
    esc = lambda c: f"replace({c}, '<|', '< |')"
    return f"""
with t as (select conv_id, turn, min(row(coalesce(role,''), coalesce(text,''))) as t from conversations where conv_id is not null and turn is not null group by all),
u as (select floor(conv_id / 2)::bigint as pair_id, ((conv_id % 2) + 2) % 2 as side, conv_id, t[1] as role, t[2] as text, row_number() over (partition by conv_id order by turn) as i from t),
m as (select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.i, b.i)) filter (a.i is null or b.i is null or a.role <> b.role or a.text <> b.text) as first, count(*) as n
  from (select * from u where side = 0) a full join (select * from u where side = 1) b on a.pair_id = b.pair_id and a.i = b.i group by 1),
k as (select pair_id, coalesce(first - 1, n) as n_common from m),
s as (select u.*, n_common, '<|' || {esc("role")} || '|>' || chr(10) as head, {esc("text")} || '<|end|>' as body from u join k using (pair_id)),
o as (select *, case when i <= n_common then 0 else sum(case when i > n_common then length(head) + length(body) + 1 else 0 end) over (partition by conv_id order by i) - length(head) - length(body) - 1 end as pos from s),
g as (select pair_id, max(conv_id) filter (side = 0) as chosen_id, max(conv_id) filter (side = 1) as rejected_id, any_value(n_common) as n_common,
  count(*) filter (side = 0 and i > n_common) as n_chosen, count(*) filter (side = 1 and i > n_common) as n_rejected,
  string_agg(head || body || chr(10), '' order by i) filter (side = 0 and i <= n_common) as prompt,
  string_agg(head || body || chr(10), '' order by i) filter (side = 0 and i > n_common) as chosen,
  string_agg(head || body || chr(10), '' order by i) filter (side = 1 and i > n_common) as rejected,
  string_agg((pos + length(head))::bigint || '-' || (pos + length(head) + length(body))::bigint, ',' order by i) filter (side = 0 and i > n_common and role = '{learn}') as chosen_spans,
  string_agg((pos + length(head))::bigint || '-' || (pos + length(head) + length(body))::bigint, ',' order by i) filter (side = 1 and i > n_common and role = '{learn}') as rejected_spans
  from o group by pair_id)
select pair_id, chosen_id, rejected_id, n_common::bigint as n_common, n_chosen::bigint as n_chosen, n_rejected::bigint as n_rejected,
  coalesce(prompt,'') as prompt, coalesce(chosen,'') as chosen, coalesce(rejected,'') as rejected, coalesce(chosen_spans,'') as chosen_spans, coalesce(rejected_spans,'') as rejected_spans from g"""
