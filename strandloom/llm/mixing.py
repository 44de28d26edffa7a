"""Mixing sources to target weights by capped water-filling.

A source's share of all words follows its weight, up to ``max_epochs`` times its
own words; what that takes away goes to the other sources by their weights, until
none is above its cap.  Sources are filled in order of cap / weight: the
ones at their cap are a prefix of that order, so one pass over running sums finds it.

A source with target t and w words is repeated t / w times: each document
``floor(t / w)`` times whole, and once more if its seeded hash of the id falls between the source's
start and cut.  Start is one of ``STARTS`` bins evenly apart and cut the edge of a hash bin, so that the words of the
documents between them come nearest to what is still missing; with so many starts, a long document
at one edge does not decide how near that is.  It needs sums per
bin only, never an ordered source, and reruns agree whatever the partitions.

Null texts have no words.  Null sources are one source, last in order.  A document
without words is taken 0 words.  Repeated rows share a hash and are taken alike.  Very
long texts are counted whole and taken whole.  An empty table gives no rows.  Rows travel packed, so their columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
BINS = 1 << 16
STARTS = 32
#: Source rows that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _bin(key: Column) -> Column:
    """A document's bin, from MD5 so that any engine gives the same."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(x)) for x in weights])
    df = sizes.withColumn("weight", F.element_at(kinds, (F.row_number().over(order) - 1) % len(weights) + 1))
    df = df.withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level)
    # The first source whose cap is above the level ends the prefix; its level holds for all after it.
    # Among sources of the same cap / weight the first has the highest level.
    open_level = -F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), (-F.col("level")).alias("down")))).over(every)["down"]
    return df.select("source", "source_size", F.least("cap", F.coalesce(open_level * F.col("weight"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, start, cut) from rows (source, size, bin)."""
    bins = staged(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate).cast("int")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = staged(goal, "mix-goal")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    edges = bins.select("source", (F.col("bin") + 1).alias("cut"), upto.alias("below"))
    edges = edges.unionByName(goal.select("source", F.lit(0).alias("cut"), F.lit(0).cast("long").alias("below"))).alias("e")
    # Words in front of each start, of every source: a row a source and start.
    fronts = F.array(*[F.struct(F.lit(i * (BINS // STARTS)).alias("start"), F.coalesce(F.sum(F.when(F.col("bin") < i * (BINS // STARTS), F.col("words"))), F.lit(0)).alias("front")) for i in range(STARTS)])
    starts = bins.groupBy("source").agg(fronts.alias("fronts"))
    open_ = goal.alias("g").join(starts.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select(F.col("g.source").alias("at"), "missing", "fronts")
    if _few(open_):
        open_ = F.broadcast(open_)
    near = edges.join(open_, F.col("e.source").eqNullSafe(F.col("at"))).select("at", "missing", "cut", "below", F.explode("fronts").alias("f")).where(F.col("cut") >= F.col("f.start"))
    off = F.abs(F.col("below") - F.col("f.front") - F.col("missing"))
    near = near.groupBy("at").agg(F.min(F.struct(off.alias("off"), F.col("f.start").alias("start"), "cut")).alias("best"))
    return goal.join(near, F.col("source").eqNullSafe(F.col("at"))).select("source", "source_size", "target", "whole", "best.start", "best.cut")


def _few(table: DataFrame) -> bool:
    return len(table.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS


def _with_plan(df: DataFrame, table: DataFrame, source: str) -> DataFrame:
    side = table.select(F.col("source").alias("_at"), F.struct("source_size", "target", "whole", "start", "cut").alias("_mix"))
    if _few(table):
        side = F.broadcast(side)
    return df.join(side, F.col(source).eqNullSafe(F.col("_at"))).withColumn("_copies", F.col("_mix.whole") + F.when((F.col("_bin") >= F.col("_mix.start")) & (F.col("_bin") < F.col("_mix.cut")), 1).otherwise(0))


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key), F.col(source).alias("source"), n_words(text).alias("size"), _bin(F.col(key)).alias("bin"))


def mixed_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words that the mix takes), copies."""
    table = staged(sized(docs), "mix-sizes")
    goal = staged(plan(table, weights, max_epochs), "mix-plan")
    out = _with_plan(table.withColumnRenamed("bin", "_bin"), goal, "source")
    return out.select("doc_id", "size", F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, all columns."""
    goal = staged(plan(staged(sized(docs), "mix-sizes"), weights, max_epochs), "mix-plan")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), _bin(F.col("doc_id")).alias("_bin"))
    out = _with_plan(packed, goal, "_source")
    again = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies"))).otherwise(F.array().cast("array<int>"))
    return out.select("_row", F.explode(again)).select("_row.*")
