"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Each source wants words in proportion to its weight and gets at most MAX_EPOCHS times its own; what it
can't take goes to the others by weight. With sources sorted by cap / weight, the level that results is
the largest of (total - caps before) / (weights from here on), so no iteration is needed.

A source's target is so many whole epochs and a part of one. For the part, documents are taken in the
order of a seeded hash of id and text until their words reach it. The place where they do is found in three
steps (of 1024 stretches of the hash, of 1024 parts of one stretch, and of the documents of that part, those of
equal id and text together), each a grouped sum, so no task sees a source's documents. One more document, the
one whose size comes nearest to what is then missing, is taken if that helps. What comes out is a few numbers
for each source, from which every row decides by itself; no table of documents is joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_tables, materialize, pick, set_apart

MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(rank, source, source_size, weight, target) of ``sources`` (source, source_size), a row for each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("double")
    level = level / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)).cast("double")
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("rank", "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _crossing(sums: DataFrame, part: str) -> DataFrame:
    """Of each rank the part in which the running sum of ``words`` passes ``need``: (rank, part, need that is left)."""
    run = F.sum("words").over(W.partitionBy("rank").orderBy(part).rowsBetween(W.unboundedPreceding, 0))
    return sums.withColumn("run", run).where((F.col("run") > F.col("need")) & (F.col("run") - F.col("words") <= F.col("need"))).select("rank", part, (F.col("need") - F.col("run") + F.col("words")).alias("need"))


def _read(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (doc_id, text, source) with id, size, the hash, its first two stretches, and a number of the row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    out = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("size", n_words(F.col("text"))).withColumn("h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    out = out.withColumn("b1", F.shiftright("h", 50).cast("int")).withColumn("b2", F.shiftright("h", 40).bitwiseAND(1023).cast("int"))
    return out.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))


_GOALS = ["rank", "source_size", "target", "whole", "c1", "c2", "at", "part", "last", "last_part"]


def _extra() -> Column:
    """Whether a row is in the part of an epoch: before the place where that ends, or, of the rows at that place, in its share."""
    place = F.struct("h", "id", "size")
    share = F.pmod("row", F.lit(1 << 30)) < F.col("part") * (1 << 30)
    at_end = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")) & ((place < F.col("at")) | ((place == F.col("at")) & share))
    return F.coalesce((F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))) | at_end, F.lit(False))


def _repeats(max_epochs: int) -> Column:
    last = (F.struct("h", "id", "size") == F.col("last")) & (F.pmod("row", F.lit(1 << 30)) < F.col("last_part") * (1 << 30))
    return F.least(F.col("whole") + _extra().cast("int") + F.coalesce(last & ~_extra(), F.lit(False)).cast("int"), F.lit(max_epochs)).cast("int")


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    return rows.join(goals.withColumnRenamed("source", "its_source"), rows["source"].eqNullSafe(F.col("its_source"))).drop("its_source")


def _goals(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """A row for each source: what a row of it needs to decide how often it is taken. A table, so that Spark knows its size and broadcasts it only if that is small."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, max_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    goal = materialize(goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    rows = _with_goals(sizes, goal.select("source", "rank", "need"))

    one = rows.groupBy("rank", "b1").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    one = materialize(_crossing(one, "b1").withColumnsRenamed({"b1": "c1", "need": "left1"}), "crossing")
    in_one = rows.drop("need").join(one, "rank").where("b1 = c1")
    two = in_one.groupBy("rank", "b2").agg(F.sum("size").alias("words"), F.first("left1").alias("need"))
    two = materialize(_crossing(two, "b2").withColumnsRenamed({"b2": "c2", "need": "left2"}), "crossing")
    three = in_one.join(two, "rank").where("b2 = c2").groupBy("rank", "h", "id", "size").agg(F.count("*").alias("n"), F.first("left2").alias("left2"))
    run = F.sum(F.col("size") * F.col("n")).over(W.partitionBy("rank").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, 0))
    three = three.withColumn("got", run - F.col("size") * F.col("n")).where((F.col("got") <= F.col("left2")) & (F.col("got") + F.col("size") * F.col("n") > F.col("left2")))
    fit = F.floor((F.col("left2") - F.col("got")) / F.col("size"))
    three = three.select("rank", F.struct("h", "id", "size").alias("at"), (fit / F.col("n")).alias("part"), (F.col("left2") - F.col("got") - fit * F.col("size")).alias("missing"))
    cut = materialize(goal.join(one.select("rank", "c1"), "rank", "left").join(two.select("rank", "c2"), "rank", "left").join(three, "rank", "left"), "cut")

    off = F.abs(F.col("size") - F.col("missing"))
    rest = _with_goals(sizes, cut.select("source", "rank", "c1", "c2", "at", "part", "missing")).where(~_extra() & (off < F.col("missing")))
    best = materialize(rest.groupBy("rank").agg(F.min(F.struct(off.alias("off"), "h", "id", "size")).alias("best")).select("rank", F.struct("best.h", "best.id", "best.size").alias("last")), "last")
    alike = rest.join(best, "rank").where(F.struct("h", "id", "size") == F.col("last")).groupBy("rank").agg((1 / F.count("*")).alias("last_part"))
    out = materialize(cut.join(best, "rank", "left").join(alike, "rank", "left").select("source", *_GOALS), "goals")
    drop_tables(goal, one, two, cut, best)
    return out


def plan(docs: DataFrame, seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, taken) for each row of ``docs`` (doc_id, text, source).

    size is the number of words, taken size times repeats. A null text has no words; a null source is a
    source; ids may be null or repeat. Of rows of equal id and text as many are taken as fit, give or take a
    few, by a hash of their place in the table. Texts are read whole, however long; those without words are
    repeated as their source's others are. Sources without words have target 0. Runs over the same table
    agree. Without rows the result is empty. Extra columns aren't read, whatever their names.
    """
    sizes = materialize(_read(pick(docs, "doc_id", "text", "source"), seed).drop("text"), "sizes")
    goals = _goals(sizes, max_epochs)
    out = _with_goals(sizes, goals).withColumn("repeats", _repeats(max_epochs))
    out = materialize(out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")), "mix")
    drop_tables(sizes, goals)
    return out


def mix(docs: DataFrame, seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as plan() says, with the columns it came with, maps and clashing names too."""
    rows, columns = set_apart(docs, "doc_id", "text", "source")
    sizes = materialize(_read(rows.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    goals = _goals(sizes, max_epochs)
    drop_tables(sizes)
    out = _with_goals(_read(rows, seed), goals).withColumn("often", _repeats(max_epochs)).where("often > 0")
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("often")))).select(*columns)


#: DuckDB. Its rows are plan()'s where ids or texts differ.
ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(doc_id, -9223372036854775808) as id,
  ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) as rank, 3 * source_size as cap from s),
w as (select *, ((rank - 1) % 3 + 1)::bigint as weight from r),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(weight) over (order by cap / weight, rank rows between current row and unbounded following))::double as level from w),
t as (select source, source_size, least(cap::double, weight * max(level) over ()) as target from l),
g as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::integer as whole from t),
n as (select *, target - whole * source_size as need from g),
x as (select d.*, n.source_size, n.target, n.whole, n.need, sum(size) over (partition by d.source order by h, id, size rows between unbounded preceding and current row) as run from d join n on d.source is not distinct from n.source),
e as (select *, run <= need as extra, need - coalesce(max(run) filter (run <= need) over (partition by source), 0) as missing from x),
b as (select source, min({'off': abs(size - missing), 'h': h, 'id': id, 'size': size}) as best from e where not extra and abs(size - missing) < missing group by source)
select e.doc_id, e.size, e.source_size, e.target, e.size * least(3, e.whole + e.extra::integer + coalesce(not e.extra and e.h = b.best.h and e.id = b.best.id, false)::integer)::bigint as taken
from e left join b on e.source is not distinct from b.source
"""
