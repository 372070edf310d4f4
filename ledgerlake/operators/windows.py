"""Operators over (entity, year): calendar shifts, ranks, quantiles, buckets, all fit for groups of any size.

Windows are taken over the few years of an entity only. What ranks a whole sector or year goes through a histogram: equal
values become one row with a count, counts are summed inside narrow ranges of values and then over the ranges of a group,
so no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of values in an octave; their number doesn't change any result.
RANGES = 64


def calendar(shift: int, by: str = "entity", year: str = "year"):
    """The row exactly `shift` years away, missing if there is none; one sort serves all shifts."""
    return Window.partitionBy(by).orderBy(year).rangeBetween(shift, shift)


def lagged(value: str, shift: int, by: str = "entity") -> Column:
    return F.max(value).over(calendar(shift, by))


def trailing(by: str = "entity", years: int = 3):
    return Window.partitionBy(by).orderBy("year").rangeBetween(1 - years, 0)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _range(v: Column) -> Column:
    """A whole number that grows with v: where its logarithm lies, for either sign."""
    size = F.floor(F.log2(F.abs(v)) * RANGES) + 2048 * RANGES
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def histogram(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """by, value, ties, before, total: how many rows of the group have the value and how many a smaller one; missing values don't count.

    With `weight` a row stands for as many rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("ties"))
    x = counts.withColumn("_range", _range(F.col(value).cast("double")))
    group = Window.partitionBy(*by)  # the ranges of a group, some thousands at most
    ranges = x.groupBy(*by, "_range").agg(F.sum("ties").alias("_sum"))
    ranges = ranges.withColumn("_below", F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_sum").over(group)).drop("_sum")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return x.join(ranges, [*by, "_range"]).select(*by, value, "ties", (F.col("_below") + F.col("_in")).alias("before"), "total")


def with_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with the mean rank of ties (`rank`), its share of the group (`pct`), the share of the group at or under the value
    (`share_below`) and the group's size (`peers`); rows without a value go."""
    h = histogram(df, value, by)
    mean = F.col("before") + (F.col("ties") + 1) / 2
    return df.join(h.select(*by, value, mean.alias("rank"), (mean / F.col("total")).alias("pct"), ((F.col("before") + F.col("ties")) / F.col("total")).alias("share_below"), F.col("total").alias("peers")), [*by, value])


def group_quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], out: str = "quantiles", weight: str | None = None) -> DataFrame:
    """by, out (an array): exact quantiles of each group, interpolated between neighbours; groups without values are absent."""
    h = histogram(df, value, by, weight)
    aggs = []
    for k, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("total") - 1)
        for name, i in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("ties")), F.col(value))).alias(f"{name}{k}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"part{k}"))
    x = h.groupBy(*by).agg(*aggs)
    return x.select(*by, F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"part{k}") for k in range(len(shares))]).alias(out))


def group_median(df: DataFrame, value: str, by: list[str], out: str, weight: str | None = None) -> DataFrame:
    return group_quantiles(df, value, by, [0.5], out, weight).withColumn(out, F.col(out)[0])


def quantile_buckets(df: DataFrame, value: str, by: str, parts: int = 5) -> DataFrame:
    """1-based bucket by interpolated quantile edges of each group; equal edges count once."""
    x = df.join(group_quantiles(df, value, [by], [k / parts for k in range(1, parts)], "_e"), by)
    return x.withColumn("bucket", F.size(F.filter(F.array_distinct("_e"), lambda e: e < F.col(value))) + 1).drop("_e")


def right_closed(value: Column, edges: list[float], missing: str = "none") -> Column:
    """Label of the interval (low, high] that holds the value."""
    out = F.when(value.isNull(), missing)
    for e in edges:
        out = out.when(value <= e, f"<= {e:g}")
    return out.otherwise(f"> {edges[-1]:g}")


def conformal_radius(df: DataFrame, error: str, by: list[str], coverage: float = 0.8) -> DataFrame:
    """by, radius: the ceil((n + 1) coverage)-th smallest error of each group, at most the largest."""
    at = F.least(F.ceil((F.col("total") + 1) * F.lit(float(coverage))), F.col("total")) - 1
    h = histogram(df, error, by)
    return h.where((F.col("before") <= at) & (at < F.col("before") + F.col("ties"))).select(*by, F.col(error).alias("radius"))


def with_radius(df: DataFrame, calibration: DataFrame, error: str, group: str, coverage: float = 0.8) -> DataFrame:
    """df with the radius of its group, or of all calibration rows where the group has none."""
    own = conformal_radius(calibration, error, [group], coverage)
    whole = conformal_radius(calibration.withColumn("_all", F.lit(1)), error, ["_all"], coverage).select("_all", F.col("radius").alias("_whole"))
    x = df.join(own, group, "left").withColumn("_all", F.lit(1)).join(F.broadcast(whole), "_all", "left")  # one row
    return x.withColumn("radius", F.coalesce("radius", "_whole")).drop("_all", "_whole")


def correlation(a: str, b: str) -> Column:
    """Of two columns of a group; missing where either is constant. Merged partial means differ in the last bit, so a constant's deviation isn't always 0, but its ends are equal."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rank_correlation(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, ic: Spearman's correlation of a and b in each group; groups in which either is constant are left out."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = with_ranks(x, a, [by]).select(by, b, F.col("rank").alias("_a"))
    x = with_ranks(x, b, [by]).select(by, "_a", F.col("rank").alias("_b"))
    return x.groupBy(by).agg(correlation("_a", "_b").alias("ic")).where("ic is not null")


def _hex(text: Column, digits: int) -> Column:
    """A whole number from the first digits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def numbered_units(df: DataFrame, unit: str) -> DataFrame:
    """(unit, number from 0) in the order of the units' md5; counted in 4,096 ranges of it, so no task sorts them all."""
    units = df.select(F.col(unit).alias("unit")).where(F.col(unit).isNotNull()).distinct().withColumn("_h", F.md5(F.col("unit").cast("string"))).withColumn("_range", _hex(F.col("unit").cast("string"), 3))
    sizes = units.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 4,096 rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "unit")) - 1
    return units.withColumn("_in", inside).join(F.broadcast(before), "_range").select("unit", (F.col("_before") + F.col("_in")).alias("number"))


def bootstrap_times(df: DataFrame, unit: str, draws: int, seed: str = "bootstrap") -> DataFrame:
    """(unit, draw, times): in each draw as many units as there are, drawn with replacement; those drawn at least once.

    The j-th unit of a draw is the one whose number a hash of seed, draw and j names, so a lost task draws alike and no list of
    units is sent anywhere: numbers are drawn, counted, and then met by their units.
    """
    units = numbered_units(df, unit)
    n = units.select(F.count(F.lit(1)).alias("_n"))
    slots = units.crossJoin(F.broadcast(n)).select(F.col("number").alias("_j"), "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))  # n: one row
    taken = slots.select("draw", (_hex(F.concat_ws("/", F.lit(seed), "draw", "_j"), 13) % F.col("_n")).alias("number")).groupBy("draw", "number").agg(F.count(F.lit(1)).alias("times"))
    return taken.join(units, "number").select("unit", "draw", "times")


def bootstrap(df: DataFrame, unit: str, draws: int, seed: str = "bootstrap") -> DataFrame:
    """df once for each draw in which its unit occurs, with `draw` and `times`; rows without a unit are in none."""
    times = bootstrap_times(df, unit, draws, seed).withColumnRenamed("unit", "_unit")
    return df.join(times, F.col(unit) == F.col("_unit")).drop("_unit")


def bootstrap_weights(df: DataFrame, unit: str, draws: int, seed: str = "bootstrap") -> DataFrame:
    """df with `times`, an array of how often its unit occurs in each draw."""
    per = bootstrap_times(df, unit, draws, seed).groupBy(F.col("unit").alias("_unit")).agg(F.map_from_entries(F.collect_list(F.struct("draw", "times"))).alias("_m"))  # an entry for each draw
    each = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)))
    return df.join(per, F.col(unit) == F.col("_unit"), "left").withColumn("times", each).drop("_unit", "_m")
