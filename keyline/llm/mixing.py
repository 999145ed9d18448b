"""Mixing sources to target weights by Poisson replication.

Every document is repeated ``k`` times, where ``k`` is drawn from a Poisson
distribution whose mean is the repetition rate of the document's source. The draw
inverts the distribution function at a uniform number made from a keyed digest of
the document, so it is the same on every run, partitioning and executor. The
copies are then put in a global order given by a second digest.

The distribution function is a table made once per source. It is summed from terms
relative to the first one in reach of the mean, by logarithms, so no rate underflows,
and one uniform number serves every rate.

The rate of a source is ``weight / sum(weights) * target_rows / rows_of_source``;
row counts are exact and cover the whole table. Sources without a weight get
``default_weight`` (0 drops them).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column, others, unused
from .storage import Scratch

#: 13 hexadecimal digits: what a double holds exactly.
_UNIT = float(16**13)
MARKS = ("mix_rate", "mix_copy", "mix_key")


def unit_interval(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts, joined with ':'."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def poisson_tables(rates: DataFrame, name: str, rate: str) -> DataFrame:
    """Per row of ``rates`` with a positive rate: name, rate, and ``table``, a struct of
    ``least``, the P(Poisson(rate) <= k) for k = least, least + 1, ... as ``sums``, and
    the powers of two up to their number, descending, as ``steps``.

    They reach 12 standard deviations and 30 from the mean, beyond which a double holds
    no more probability; those that no uniform number of 52 bits can reach are left out.
    """
    reach = 12.0 * F.sqrt(F.col("m")) + 30.0
    rows = rates.select(F.col(name).alias("s"), F.col(rate).cast("double").alias("m")).filter("m > 0")
    least = F.greatest(F.floor(F.col("m") - reach), F.lit(0)).cast("long")
    rows = rows.withColumn("least", least)
    rows = rows.withColumn("k", F.explode(F.sequence("least", F.ceil(F.col("m") + reach).cast("long"))))
    upto = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == F.col("least"), 0.0).otherwise(F.log(F.col("m") / F.col("k")))
    rows = rows.withColumn("term", F.exp(F.sum(step).over(upto)))
    rows = rows.withColumn("c", F.sum("term").over(upto) / F.sum("term").over(Window.partitionBy("s")))
    rows = rows.filter((F.col("c") <= 1.0 - 2.0**-52) | (F.col("k") == F.col("least")))
    made = rows.groupBy("s").agg(
        F.first("m").alias("m"), F.min("least").alias("least"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("all")
    )
    steps = F.transform(F.sequence(F.floor(F.log2(F.size("all"))).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2), i).cast("int"))
    table = F.struct("least", F.transform("all", lambda e: e["c"]).alias("sums"), steps.alias("steps"))
    return made.select(F.col("s").alias(name), F.col("m").alias(rate), table.alias("table"))


def poisson_draw(u: Column, table: Column) -> Column:
    """Smallest k whose sum exceeds ``u``, by bisection; 0 for a null table (no positive rate)."""
    sums = table["sums"]
    below = F.aggregate(
        table["steps"], F.lit(0), lambda at, step: F.when(F.get(sums, at + step - 1) <= u, at + step).otherwise(at)
    )
    return F.when(table.isNull(), F.lit(0).cast("long")).otherwise(table["least"] + below)


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None,
    target_rows: int | None,
    source: str,
    default_weight: float,
    scratch: Scratch,
) -> DataFrame:
    """One row per source of positive weight (null is a source of its own): s, its repetition rate, its table.

    Written to the shared folder, so its size is known where it is joined.
    """
    rows = scratch.save(docs.groupBy(column(source).alias("s")).agg(F.count(F.lit(1)).alias("n")), "sources")
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("s").cast("string") == name, F.lit(float(value))).otherwise(weight)
    rows = rows.withColumn("w", weight)
    total = rows.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(target_rows if target_rows is not None else total["n"] or 0)
    rate = F.col("w") / F.lit(total["w"] or 1.0) * F.lit(wanted) / F.col("n")
    return scratch.save(poisson_tables(rows.withColumn("rate", rate), "s", "rate"), "rates")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    target_rows: int | None = None,
    seed: str = "mix",
    key: str = "doc_id",
    source: str = "source",
    told_by: Sequence[str] = (),
    default_weight: float = 1.0,
    keep_marks: bool = True,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Repeat documents to meet the source weights and shuffle them globally.

    With ``keep_marks`` the result has three more columns: ``mix_rate``,
    ``mix_copy`` (0-based number of the copy) and ``mix_key`` (order in the global
    shuffle); they replace columns of these names. Rows come range-partitioned and
    sorted by that order. All other columns, whatever their names, pass through.

    Defined results: a null key draws like the text 'null'; equal keys draw equal
    counts, so repeated rows are all kept or dropped alike; an empty table gives
    an empty table. ``told_by`` names columns that tell rows with equal keys apart in the
    order, so that a key with very many rows is dealt over all partitions.

    The table of rates has one row per source. Spark broadcasts it if its written size is
    below its threshold, and otherwise joins with skew splitting. The order's digest is
    uniform, so its first digits are the partition: no sampling pass reads the rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    rates = source_rates(docs, weights, target_rows, source, default_weight, scratch)
    s, rate, table, count, copy, order = unused([*docs.columns, *MARKS], "s", "rate", "table", "count", "copy", "order")
    rates = rates.select(F.col("s").alias(s), F.col("rate").alias(rate), F.col("table").alias(table))
    ident = F.coalesce(column(key).cast("string"), F.lit("null"))
    draw = poisson_draw(unit_interval(seed, "count", ident), F.col(table))
    drawn = docs.join(rates, column(source).eqNullSafe(F.col(s))).withColumn(count, draw)
    told = [F.md5(F.concat_ws(":", *[F.coalesce(column(c).cast("string"), F.lit("null")) for c in told_by]))] if told_by else []
    copies = drawn.filter(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))
    copies = copies.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, *told, F.col(copy).cast("string"))))
    kept = others(docs.columns, MARKS) if keep_marks else docs.columns
    copies = copies.select(*map(column, kept), rate, copy, order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * parts / 2**32).cast("int")
    shuffled = copies.repartitionById(parts, place).sortWithinPartitions(order)
    marks = [F.col(c).alias(m) for c, m in zip((rate, copy, order), MARKS, strict=True)] if keep_marks else []
    return shuffled.select(*map(column, kept), *marks)
