"""Preference formatting: pairs of a chosen and a rejected conversation as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt. What follows is
rendered as each side's completion. A completion's spans are the stretches to learn from: the texts of
its assistant turns, closing mark included; all else, the prompt too, is masked. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
LEARNED = "assistant"


def _role(t: Column) -> Column:
    return F.coalesce(t["role"], F.lit("none"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), _role(t), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column) -> Column:
    """Array of (begin, end), in characters of the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        one = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(_role(t) == LEARNED, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, n), lambda t, i: t["role"].eqNullSafe(F.get(b, i)["role"]) & t["text"].eqNullSafe(F.get(b, i)["text"]))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def format_pairs(turns: DataFrame) -> DataFrame:
    """Formats ``turns`` (pair_id, side, turn, role, text), side being ``chosen`` or ``rejected``.

    One row for each pair_id: pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.
    Turns are ordered by turn, then role and text; equal rows are turns of their own. A null role renders
    as ``none``, a null text as empty. Rows of a null pair_id are left out. If a side is missing, prompt is empty
    and that side null. If one side is a prefix of the other, or equal to it, its completion is empty.
    """
    cols = pick(turns, "pair_id", "side", "turn", "role", "text").where("pair_id is not null")
    turn = F.struct("turn", "role", "text")
    both = cols.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")])
    return format_sides(both.where((F.size("chosen") > 0) | (F.size("rejected") > 0)))


def format_sides(both: DataFrame) -> DataFrame:
    """format_pairs() of (pair_id, chosen, rejected), each side an array of (turn, role, text) in order; a side that is missing is empty."""
    both = both.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s), F.lit(1)))
    there = lambda s, x: F.when(F.size(s) > 0, x)
    return both.select(
        "pair_id", F.col("n").alias("prompt_turns"), render(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        there("chosen", render(rest("chosen"))).alias("chosen"), there("chosen", spans(rest("chosen"))).alias("chosen_spans"),
        there("rejected", render(rest("rejected"))).alias("rejected"), there("rejected", spans(rest("rejected"))).alias("rejected_spans"),
    )


def swapped_ends(conversations: DataFrame) -> DataFrame:
    """Sides for format_sides() of a table that has no preferences of its own, a pair for each conversation.

    Chosen is the conversation, rejected the same up to its last turn, which comes from its neighbour
    instead (2n and 2n + 1 are neighbours). Without a neighbour there is no rejected side. Rows of a null
    conv_id are left out; equal rows are turns of their own; other columns aren't read.
    """
    c = pick(conversations, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long")).where("conv_id is not null")
    turn = F.struct("turn", "role", "text")
    whole = c.groupBy(F.col("conv_id").alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias("chosen"))
    last = c.groupBy(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id")).agg(F.max(turn).alias("last"))
    head = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    rejected = F.when(F.col("last").isNotNull(), F.concat(head, F.array("last"))).otherwise(F.slice("chosen", 1, 0))
    return whole.join(last, "pair_id", "left").select("pair_id", "chosen", rejected.alias("rejected"))


def digests(pairs: DataFrame) -> DataFrame:
    """Digest columns of format_pairs()."""
    text = lambda s: F.array_join(F.transform(F.col(f"{s}_spans"), lambda x: F.concat(x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    out = [F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")]
    for s in ("chosen", "rejected"):
        out += [F.md5(F.col(s).cast("binary")).alias(f"{s}_md5"), text(s).alias(f"{s}_mask")]
    return pairs.select("pair_id", "prompt_turns", *out)


ORACLE_SQL = r"""
with c as (select conv_id, role, text, count(*) over (partition by conv_id) as size,
  row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i from conversations where conv_id is not null),
z as (select xor(conv_id, 1) as conv_id, role, text from c where i = size),
s as (select conv_id as pair_id, 0 as side, i, role, text from c union all
  select c.conv_id, 1, c.i, case when i < size then c.role else z.role end, case when i < size then c.text else z.text end from c join z using (conv_id)),
t as (select *, '<|' || coalesce(role, 'none') || '|>' || chr(10) as head, coalesce(text, '') || '<|end|>' || chr(10) as body from s),
n as (select pair_id, count(distinct side) as sides, max(i) filter (side = 0) as n0, max(i) filter (side = 1) as n1 from t group by 1),
d as (select a.pair_id, min(a.i) as first_diff from t a join t b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1
  where a.role is distinct from b.role or a.text is distinct from b.text group by 1),
l as (select n.pair_id, n0, n1, case when sides < 2 then 0 else coalesce(first_diff - 1, least(n0, n1)) end as k from n left join d using (pair_id)),
x as (select t.*, l.k, l.n0, l.n1, i <= k as shared,
  sum(length(head) + length(body)) over (partition by t.pair_id, side, i <= k order by i) - length(body) as begin_at from t join l using (pair_id))
select pair_id, any_value(k)::integer as prompt_turns,
  md5(coalesce(string_agg(head || body, '' order by i) filter (shared and side = 0), '')) as prompt_md5,
  case when any_value(n0) is not null then md5(coalesce(string_agg(head || body, '' order by i) filter (not shared and side = 0), '')) end as chosen_md5,
  case when any_value(n0) is not null then coalesce(string_agg(begin_at || '-' || (begin_at + length(body)), ',' order by i) filter (not shared and side = 0 and role = 'assistant'), '') end as chosen_mask,
  case when any_value(n1) is not null then md5(coalesce(string_agg(head || body, '' order by i) filter (not shared and side = 1), '')) end as rejected_md5,
  case when any_value(n1) is not null then coalesce(string_agg(begin_at || '-' || (begin_at + length(body)), ',' order by i) filter (not shared and side = 1 and role = 'assistant'), '') end as rejected_mask
from x group by pair_id
"""
