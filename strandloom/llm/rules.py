"""Quality rules with thresholds that follow the corpus (DataFrame operators only).

For each text the rules measure four rates.  For each rate, a mergeable quantile
sketch is kept per language and source: counts over log-linear bins, exact below
64 and within 1/32 above, so that sketches of parts add up to the sketch of the
whole, whatever the parts.  A group's fence for a rate is

    q75 + SPREAD * max(q75 - q25, least spread of the rate)

and a text beyond a fence of its own group is rejected, as is one that breaks a
base rule.  Quantiles are those of texts that pass the base rules; a group
with fewer than ``MIN_GROUP`` such texts takes the fences of the whole corpus.

Null texts count as empty (no words, base rule broken).  Null languages and
sources are groups of their own.  Repeated rows count as often as they occur, and are judged alike.  Very long texts are
measured whole.  An empty table gives no rows.  The filter packs its rows, so their columns may have any names.

The least spread of ``repeat_rate`` puts its fence above what the base rule lets pass, so that one repeated line of a short
clean text stays: repeats are judged by the base rule, the other rates by their fences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import staged

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SPREAD = 3
MIN_GROUP = 30
#: The rates, in thousandths, and the least spread of each.
RATES = {"symbol_rate": 50, "dup_line_rate": 100, "repeat_rate": 70, "word_length": 2000}
#: Fence rows that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 50_000

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _windows(hashes: Column) -> Column:
    """Hash of each five consecutive words: of two, of two such, and of the fifth."""
    n = F.size(hashes)
    two = lambda h: _pairs(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1))
    four = lambda p: _pairs(F.slice(p, F.lit(1), F.size(p) - 2), F.slice(p, F.lit(3), F.size(p) - 2))
    whole = _let(two(hashes), lambda p: _pairs(F.slice(four(p), F.lit(1), F.size(p) - 3), F.slice(hashes, F.lit(5), F.size(p) - 3)))
    return F.when(n >= WINDOW, whole).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Windows are sorted by (hash, place); those equal to a neighbour are kept and
    put back in order of place.  Each covers up to the next one's start, at most
    its own five words.
    """
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(
        ranked,
        lambda r: F.sort_array(
            F.flatten(
                F.filter(
                    F.zip_with(
                        F.slice(r, F.lit(1), F.size(r) - 1),
                        F.slice(r, F.lit(2), F.size(r) - 1),
                        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
                    ),
                    lambda x: x.isNotNull(),
                )
            )
        ),
    )
    steps = F.aggregate(
        again,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).cast("long").alias("n")),
    )
    return steps["n"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``_rules``, a struct of the counts, the base verdict and the rates."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_body", body)
    df = df.withColumn("_words", F.filter(F.split(F.col("_body"), _SPACE), lambda w: w != ""))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_lines", F.filter(F.split(F.col("_body"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_windows", _windows(F.col("_hashes")))
    n_windows = F.size("_windows")
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.size(F.split(F.col("_body"), "[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_repeat_words": F.when((n_windows > 1) & (F.size(F.array_distinct("_windows")) < n_windows), _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long"),
    }
    df = df.withColumn("_rules", F.struct(*[c.alias(k) for k, c in counts.items()])).drop("_body", "_words", "_hashes", "_lines", "_windows")
    r = F.col("_rules")
    per = lambda a, b: F.expr(f"CASE WHEN _rules.{b} > 0 THEN (1000 * _rules.{a}) DIV _rules.{b} ELSE 0 END")
    rules = F.struct(
        *[r[k].alias(k) for k in counts],
        ((r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > REPEAT_PERCENT * r["n_words"])).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("word_chars", "n_words").alias("word_length"),
    )
    # A generator of one row: filters on the measures are not pushed below it, where they would be computed again.
    rest = [c for c in df.columns if c != "_rules"]
    return df.select(*rest, F.explode(F.array(rules)).alias("_rules"))


def _binned(value: str) -> Column:
    """The lower bound of a value's bin: itself below 64, else its six leading bits."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bin, n): the mergeable sketch, one row a bin.  ``measures`` has ``_rules``."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), _binned(f"_rules.{k}").alias("bin")) for k in RATES]))
    return (
        measures.where(~F.col("_rules.base_failed"))
        .select(*keys, rates.alias("r"))
        .groupBy(*keys, F.col("r.rate").alias("rate"), F.col("r.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups: bins add up."""
    return sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_texts, one fence a rate) from a sketch."""
    by = [*keys, "rate"]
    run = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    q = run.groupBy(*by).agg(
        F.max("all").alias("n_texts"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("q25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("q75"),
    )
    least = reduce(lambda c, kv: c.when(F.col("rate") == kv[0], F.lit(kv[1])), RATES.items(), F.when(F.lit(False), F.lit(0)))
    fence = F.col("q75") + SPREAD * F.greatest(F.col("q75") - F.col("q25"), least)
    return q.groupBy(*keys).agg(F.max("n_texts").alias("n_texts"), *[F.max(F.when(F.col("rate") == k, fence)).alias(f"max_{k}") for k in RATES])


def thresholds(measures: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each group of ``measures``: keys, n_texts and the fences that hold there."""
    own = sketches(measures, list(keys))
    table = staged(own, "rules-sketch")
    groups = fences(table, list(keys))
    whole = fences(merged(table, []), [])
    names = [f"max_{k}" for k in RATES]
    both = groups.join(F.broadcast(whole.select(*[F.col(c).alias(f"all_{c}") for c in names])), how="cross")  # one row
    return both.select(*keys, "n_texts", *[F.when(F.col("n_texts") >= MIN_GROUP, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in names])


def judged(measures: DataFrame, limits: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``measures`` with the boolean column ``_kept``.

    ``limits`` is broadcast if it has at most BROADCAST_ROWS rows, else the join shuffles
    (a hot group is then split by adaptive execution).
    """
    names = [f"max_{k}" for k in RATES]
    side = limits.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*names).alias("_limits"))
    if len(limits.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    over = reduce(lambda a, b: a | b, [F.col(f"_rules.{k}") > F.col(f"_limits.max_{k}") for k in RATES])
    return measures.join(side, on, "left").withColumn("_kept", ~(F.col("_rules.base_failed") | F.coalesce(over, F.lit(False)))).drop(*[f"_{k}" for k in keys], "_limits")


def quality_rules(docs: DataFrame, text: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row a document: its id, the counts, base_failed and kept."""
    table = staged(measured(docs.select("doc_id", F.col(text), *keys), text).drop(text), "rules-measures")
    out = judged(table, staged(thresholds(table, keys), "rules-fences"), keys)
    return out.select("doc_id", *[F.col(f"_rules.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame, text: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns.

    Measures are taken twice, once for the fences and once to filter, so that whole
    rows neither shuffle nor need an id.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text), *keys)
    first = staged(measured(packed.drop("_row"), text).select("_rules", *keys), "rules-measures")
    limits = staged(thresholds(first, keys), "rules-fences")
    return judged(measured(packed, text), limits, keys).where("_kept").select("_row.*")
