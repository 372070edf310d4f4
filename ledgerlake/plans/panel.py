"""The yearly panel: an entity is a customer, a period a calendar year, a sector a market segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import windows as W
from ..sources.tables import parquet


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """entity, year, revenue, n_orders, largest: one row for each customer and year with an order."""
    return (
        parquet(spark, d, "orders")
        .select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), "o_totalprice")
        .groupBy("entity", "year")
        .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest"))
    )


YEARLY = """yearly AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS revenue,
  count(*) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY 1, 2)"""


def with_growth(df: DataFrame) -> DataFrame:
    return df.withColumn("prior", W.lagged("revenue", -1)).withColumn("rev_g", C.growth(F.col("revenue"), F.col("prior")))


GROWTH = YEARLY + """, grown AS (SELECT y.*, p.revenue AS prior, CASE WHEN p.revenue > 0 THEN y.revenue / p.revenue END - 1 AS rev_g
  FROM yearly y LEFT JOIN yearly p ON p.entity = y.entity AND p.year = y.year - 1)"""


def with_sector(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    c = parquet(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("sector"))
    return df.join(c, "entity", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))


SECTOR = GROWTH + """, panel AS (SELECT g.*, coalesce(c_mktsegment, 'unknown') AS sector FROM grown g LEFT JOIN customer ON c_custkey = entity)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    return with_sector(spark, d, with_growth(yearly(spark, d)))


def r(name: str, places: int = 5):
    return F.round(F.col(name), places).alias(name)


#: Which codes may fill a field, best first.
PREFERENCES = {"settled": ["AF", "RF"], "open": ["NO", "NF"]}


def wide_pivot_priority(spark, d):
    x = parquet(spark, d, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.sum("l_quantity").alias("q"))
    pick = lambda codes: F.min_by("q", F.when(F.col("code").isin(codes), F.array_position(F.array(*map(F.lit, codes)), F.col("code"))))
    return x.groupBy("l_suppkey").agg(*(pick(c).alias(f) for f, c in PREFERENCES.items())).select("l_suppkey", *(F.when(F.col(f).isNotNull(), F.round(f, 2)).alias(f) for f in PREFERENCES))


def melt_long_roundtrip(spark, d):
    x = yearly(spark, d).select("entity", "year", F.round("revenue", 2).alias("revenue"), F.col("n_orders").cast("double"), "largest")
    return x.unpivot(["entity", "year"], ["revenue", "n_orders", "largest"], "field", "value").where("value is not null")


def select_best_per_group(spark, d):
    o = parquet(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return W.first_per_group(o, ["o_custkey", "year"], [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "year", "o_orderkey")


def group_flag_broadcast(spark, d):
    o = parquet(spark, d, "orders")
    any_ = F.bool_or(F.col("o_orderstatus") == "P").over(Window.partitionBy("o_custkey"))
    scope = F.when(F.col("o_orderstatus") == "P", "consolidated").when(any_, "parent").otherwise("single")
    return o.select("o_orderkey", scope.alias("scope"))


def identity_rel_err(spark, d):
    lines = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    x = parquet(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    err = C.relative_error(F.col("o_totalprice"), F.col("total"))
    return x.select("o_orderkey", F.round(err, 6).alias("err"), C.holds(err <= 0.5).alias("ok"))


def semi_anti_membership(spark, d):
    y = yearly(spark, d).select("entity", "year")
    span = y.groupBy("entity").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select("entity", F.explode(F.sequence("a", "b")).alias("year")).join(y, ["entity", "year"], "left_anti")


def calendar_lag_growth(spark, d):
    x = yearly(spark, d).withColumn("lag1", W.lagged("revenue", -1)).withColumn("lag2", W.lagged("revenue", -2)).withColumn("next", W.lagged("revenue", 1))
    x = x.withColumn("rev_g", C.growth(F.col("revenue"), F.col("lag1")))
    return x.select("entity", "year", r("lag1", 2), r("lag2", 2), r("next", 2), r("rev_g"))


def rolling3_mean_std(spark, d):
    x = with_growth(yearly(spark, d)).withColumn("rev_g", C.clip(F.col("rev_g"), -0.95, 5.0))
    w = W.trailing()
    return x.withColumn("mean3", F.avg("rev_g").over(w)).withColumn("std3", F.stddev_samp("rev_g").over(w)).select("entity", "year", r("mean3"), r("std3"))


def feature_ratios(spark, d):
    x = with_growth(yearly(spark, d))
    return x.select("entity", "year", F.round(C.safe_div(F.col("revenue"), F.col("n_orders")), 6).alias("per_order"), F.round(C.safe_div(F.col("largest"), F.col("revenue")), 6).alias("concentration"), F.round(C.clip(F.col("rev_g"), -0.95, 5.0), 5).alias("rev_g"), F.round(F.ln("revenue"), 5).alias("log_revenue"))


def sector_year_median(spark, d):
    p = panel(spark, d)
    sizes = p.groupBy("sector", "year").agg(F.count(F.lit(1)).alias("sector_n"))
    return sizes.join(W.group_median(p, "rev_g", ["sector", "year"], "m"), ["sector", "year"], "left").select("sector", "year", F.round("m", 5).alias("sector_rev_g"), "sector_n")


def pct_rank_in_sector(spark, d):
    x = W.with_ranks(panel(spark, d), "rev_g", ["sector", "year"])
    return x.select("entity", "year", "sector", r("pct", 6))


def peer_stats(spark, d):
    p = panel(spark, d).select("entity", "year", "sector", F.round("rev_g", 8).alias("rev_g"))
    x = W.with_ranks(p, "rev_g", ["sector", "year"]).join(W.group_median(p, "rev_g", ["sector", "year"], "mid"), ["sector", "year"])
    return x.where("peers >= 5").select("entity", "year", F.col("peers").alias("n"), F.round("share_below", 6).alias("below"), F.round("mid", 5).alias("sector_median"))


def target_next_year(spark, d):
    x = yearly(spark, d).withColumn("after", W.lagged("revenue", 1))
    gap = F.abs(F.ln(F.col("after") / F.col("revenue")))
    return x.select("entity", "year", F.round(F.when((F.col("after") > 0) & (F.col("revenue") > 0), F.ln(F.col("after") / F.col("revenue"))), 5).alias("target"), C.holds(gap > F.ln(F.lit(1.25))).alias("jump"), (C.holds(F.col("after") > 0) & ~C.holds(gap > F.ln(F.lit(1.25)))).alias("has_target"))


def group_centered(spark, d):
    x = with_growth(yearly(spark, d)).where("rev_g is not null").select("entity", "year", C.clip(F.col("rev_g"), -1.0, 1.0).alias("y"))
    return x.join(W.group_median(x, "y", ["year"], "mid"), "year").select("entity", "year", F.round(F.col("y") - F.col("mid"), 5).alias("centered"))


def median_of_medians(spark, d):
    m = W.group_median(panel(spark, d), "rev_g", ["sector", "year"], "m")
    return m.groupBy("year").agg(F.round(F.median("m"), 5).alias("market"))  # a row for each sector


def qcut_quintiles(spark, d):
    x = yearly(spark, d).withColumn("revenue", F.round("revenue", 2))
    return W.quantile_buckets(x, "revenue", "year").select("entity", "year", "bucket")


EDGES = [0.05, 0.1, 0.2, 0.4]


def _errors(spark, d):
    x = with_growth(yearly(spark, d)).withColumn("std3", F.round(F.stddev_samp("rev_g").over(W.trailing()), 8))
    x = x.withColumn("vol", W.right_closed(F.col("std3"), EDGES))
    return x.where("rev_g is not null").withColumn("err", F.abs(F.round("rev_g", 6)))


def vol_bins(spark, d):
    return _errors(spark, d).groupBy("vol").agg(F.count(F.lit(1)).alias("n"))


def conformal_radius(spark, d):
    return W.conformal_radius(_errors(spark, d), "err", ["vol"])


def coverage_by_group(spark, d):
    e = _errors(spark, d)
    x = W.with_radius(e, e, "err", "vol")
    return x.groupBy("vol").agg(F.round(F.avg((F.col("err") <= F.col("radius")).cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


def spearman_ic(spark, d):
    x = with_growth(yearly(spark, d)).where("rev_g is not null").select("entity", "year", F.round("rev_g", 8).alias("g"), "n_orders")
    return W.rank_correlation(x, "g", "n_orders", "year").select("year", F.round("ic", 5).alias("ic"))


def mae_rmse_baselines(spark, d):
    x = with_growth(yearly(spark, d)).withColumn("guess", W.lagged("rev_g", -1)).where("rev_g is not null and guess is not null")
    y, g = C.clip(F.col("rev_g"), -0.95, 5.0), C.clip(F.col("guess"), -0.95, 5.0)
    m = x.select("year", F.abs(y - g).alias("e"), F.abs(y).alias("z")).groupBy("year").agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("z").alias("mae0"))
    return m.select("year", r("mae", 4), r("rmse", 4), F.round(1 - C.safe_div(F.col("mae"), F.col("mae0")), 4).alias("improvement"))


def walk_forward_counts(spark, d):
    n = yearly(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row for each year
    return n.select(F.col("year").alias("fold"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("train"), F.col("n").alias("test")).where("train > 0")


def cagr_endpoints(spark, d):
    x = yearly(spark, d).groupBy("entity").agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("revenue", "year").alias("v0"), F.max_by("revenue", "year").alias("v1"))
    ok = (F.col("y1") > F.col("y0")) & (F.col("v0") > 0) & (F.col("v1") > 0)
    return x.select("entity", F.round(F.when(ok, F.pow(F.col("v1") / F.col("v0"), F.lit(1.0) / (F.col("y1") - F.col("y0"))) - 1), 5).alias("cagr"))


def latest_per_key(spark, d):
    o = parquet(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def full_outer_ratios(spark, d):
    big = parquet(spark, d, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_big"))
    late = parquet(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_open"))
    return big.join(late, "o_custkey", "full_outer").select("o_custkey", "n_big", "n_open")


SIGNALS = ("growth_drop", "one_order_year", "concentrated")


def risk_flags(spark, d):
    x = with_growth(yearly(spark, d))
    flags = F.array_compact(F.array(F.when(C.holds(F.col("rev_g") < -0.5), SIGNALS[0]), F.when(F.col("n_orders") == 1, SIGNALS[1]), F.when(C.holds(C.safe_div(F.col("largest"), F.col("revenue")) > 0.8), SIGNALS[2])))
    return x.select("entity", "year", F.explode(flags).alias("flag"))


def _components(x: DataFrame) -> dict:
    """Index-like ratios of a year to the year before."""
    prior = lambda c: W.lagged(c, -1)
    return {"sgi": C.safe_div(F.col("revenue"), prior("revenue")), "dsri": C.safe_div(F.col("n_orders").cast("double"), prior("n_orders").cast("double")), "tata": C.safe_div(F.col("largest"), F.col("revenue"))}


def beneish_score(spark, d):
    x = yearly(spark, d)
    for name, c in _components(x).items():
        x = x.withColumn(name, c)
    index = lambda c: F.coalesce(C.clip(F.col(c), 0.0, 10.0), F.lit(1.0))
    # the indices that orders don't give are missing, so each of them counts as no change
    score = -4.84 + 0.92 * index("dsri") + 0.892 * index("sgi") + 4.679 * C.clip(F.col("tata"), -1.0, 1.0) + (0.528 + 0.404 + 0.115 - 0.172 - 0.327)
    return x.select("entity", "year", F.round(F.when(F.col("tata").isNotNull() & F.col("sgi").isNotNull(), score), 5).alias("m_score"))


def forecast_bounds(spark, d):
    """Next year's growth as the market's median on the log scale, give or take the radius of the entity's volatility group."""
    x = with_growth(yearly(spark, d)).withColumn("vol", W.right_closed(F.round(F.stddev_samp("rev_g").over(W.trailing()), 8), EDGES)).where("rev_g > -1")
    x = x.withColumn("g", F.round(C.clip(F.log1p("rev_g"), -1.0, 1.0), 8)).select("entity", "year", "vol", "g")
    market = W.group_median(x, "g", ["year"], "m")
    errors = x.join(market, "year").withColumn("err", F.abs(F.round(F.col("g") - F.col("m"), 8)))
    middle = market.agg(F.median("m").alias("middle"))  # one row, from a row for each year
    x = W.with_radius(x, errors, "err", "vol").crossJoin(F.broadcast(middle))
    bound = lambda sign: F.round(F.expm1(F.col("middle") + sign * F.col("radius")), 5)
    return x.select("entity", "year", bound(-1).alias("low"), bound(0).alias("mid"), bound(1).alias("high"))


def metric_rows_format(spark, d):
    x = yearly(spark, d).withColumn("share", F.round(C.safe_div(F.col("largest"), F.col("revenue")), 3))
    return x.select(F.concat_ws(".", "entity", F.lit("concentration"), "year").alias("id"), C.format_metric(F.col("share"), F.lit("pct"), "vi").alias("vi"), C.format_metric(F.col("share"), F.lit("pct"), "en").alias("en"))


def comparison_table(spark, d):
    x = yearly(spark, d).where("entity in (1, 2, 4)")
    p = x.groupBy("year").pivot("entity", [1, 2, 4]).agg(F.round(F.sum("revenue"), 2))
    return p.select("year", *(F.coalesce(F.format_number(F.col(str(k)), 0), F.lit("—")).alias(f"e{k}") for k in (1, 2, 4)))


def cluster_bootstrap(spark, d):
    """Revenue of each of 30 bootstrap draws of whole entities."""
    x = W.bootstrap(yearly(spark, d), "entity", draws=30)
    return x.groupBy("draw").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("revenue") * F.col("times")) / F.sum("times"), 2).alias("mean"))


def bootstrap_times(spark, d):
    """How often each draw takes each entity: every draw has as many as there are."""
    return W.bootstrap_times(yearly(spark, d), "entity", draws=30)


def replace_by_key(spark, d):
    from ..sources.tables import replaced

    o = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    new = o.where("o_orderkey % 10 = 0").withColumn("version", F.lit(2))
    return replaced(o, new, ["o_orderkey"])


def union_concat(spark, d):
    a, b = parquet(spark, d, "customer").select(F.col("c_nationkey").alias("k")), parquet(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def distinct_sets(spark, d):
    o = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    want = F.array(F.lit("F"), F.lit("O"))
    return o.select("o_custkey", F.array_join(F.array_sort(F.array_intersect("s", want)), ",").alias("both"), F.array_join(F.array_sort(F.array_except(want, "s")), ",").alias("missing"))


QUERIES = {f.__name__: f for f in (wide_pivot_priority, melt_long_roundtrip, select_best_per_group, group_flag_broadcast, identity_rel_err, semi_anti_membership, calendar_lag_growth, rolling3_mean_std, feature_ratios, sector_year_median, pct_rank_in_sector, peer_stats, target_next_year, group_centered, median_of_medians, qcut_quintiles, vol_bins, conformal_radius, coverage_by_group, spearman_ic, mae_rmse_baselines, walk_forward_counts, cagr_endpoints, latest_per_key, full_outer_ratios, risk_flags, beneish_score, forecast_bounds, metric_rows_format, comparison_table, cluster_bootstrap, bootstrap_times, replace_by_key, union_concat, distinct_sets)}

_RANKS = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"
_CLIP = "CASE WHEN {x} IS NOT NULL THEN greatest({a}::DOUBLE, least({b}::DOUBLE, {x})) END"
_ERRORS = GROWTH + """, vols AS (SELECT *, round(stddev_samp(rev_g) OVER (PARTITION BY entity ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 8) AS std3 FROM grown),
errors AS (SELECT *, abs(round(rev_g, 6)) AS err, CASE WHEN std3 IS NULL THEN 'none' WHEN std3 <= 0.05 THEN '<= 0.05' WHEN std3 <= 0.1 THEN '<= 0.1' WHEN std3 <= 0.2 THEN '<= 0.2'
  WHEN std3 <= 0.4 THEN '<= 0.4' ELSE '> 0.4' END AS vol FROM vols WHERE rev_g IS NOT NULL),
radii AS (SELECT vol, err AS radius FROM (SELECT vol, err, row_number() OVER (PARTITION BY vol ORDER BY err) AS k, count(*) OVER (PARTITION BY vol) AS n FROM errors)
  WHERE k = least(ceil((n + 1) * 0.8::DOUBLE), n))"""

ORACLES = {
    "wide_pivot_priority": "SELECT l_suppkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'AF'), sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'RF')), 2) AS settled, round(coalesce(sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'NO'), sum(l_quantity) FILTER (l_returnflag || l_linestatus = 'NF')), 2) AS open FROM lineitem GROUP BY 1",
    "melt_long_roundtrip": f"WITH {YEARLY} SELECT entity, year, 'revenue' AS field, round(revenue, 2) AS value FROM yearly UNION ALL SELECT entity, year, 'n_orders', n_orders::DOUBLE FROM yearly UNION ALL SELECT entity, year, 'largest', largest FROM yearly",
    "select_best_per_group": "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1",
    "group_flag_broadcast": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'consolidated' WHEN bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) THEN 'parent' ELSE 'single' END AS scope FROM orders",
    "identity_rel_err": "WITH t AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey, CASE WHEN total IS NULL OR o_totalprice IS NULL THEN NULL WHEN greatest(abs(o_totalprice), abs(total)) = 0 THEN 0.0 ELSE abs(o_totalprice - total) / greatest(abs(o_totalprice), abs(total)) END AS err FROM orders LEFT JOIN t ON l_orderkey = o_orderkey) SELECT o_orderkey, round(err, 6) AS err, coalesce(err <= 0.5, false) AS ok FROM e",
    "semi_anti_membership": f"WITH {YEARLY} SELECT entity, CAST(y AS INTEGER) AS year FROM (SELECT entity, unnest(generate_series(min(year), max(year))) AS y FROM yearly GROUP BY 1) s WHERE NOT EXISTS (SELECT 1 FROM yearly t WHERE t.entity = s.entity AND t.year = s.y)",
    "calendar_lag_growth": f"WITH {YEARLY} SELECT y.entity, y.year, round(a.revenue, 2) AS lag1, round(b.revenue, 2) AS lag2, round(c.revenue, 2) AS next, round(CASE WHEN a.revenue > 0 THEN y.revenue / a.revenue END - 1, 5) AS rev_g FROM yearly y LEFT JOIN yearly a ON a.entity = y.entity AND a.year = y.year - 1 LEFT JOIN yearly b ON b.entity = y.entity AND b.year = y.year - 2 LEFT JOIN yearly c ON c.entity = y.entity AND c.year = y.year + 1",
    "rolling3_mean_std": f"WITH {GROWTH}, c AS (SELECT entity, year, {_CLIP.format(x='rev_g', a=-0.95, b=5)} AS g FROM grown) SELECT entity, year, round(avg(g) OVER w, 5) AS mean3, round(stddev_samp(g) OVER w, 5) AS std3 FROM c WINDOW w AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "feature_ratios": f"WITH {GROWTH} SELECT entity, year, round(revenue / n_orders, 6) AS per_order, round(CASE WHEN revenue > 0 THEN largest / revenue END, 6) AS concentration, round({_CLIP.format(x='rev_g', a=-0.95, b=5)}, 5) AS rev_g, round(ln(revenue), 5) AS log_revenue FROM grown",
    "sector_year_median": f"WITH {SECTOR} SELECT sector, year, round(median(rev_g), 5) AS sector_rev_g, count(*) AS sector_n FROM panel GROUP BY 1, 2",
    "pct_rank_in_sector": f"WITH {SECTOR}, k AS (SELECT * FROM panel WHERE rev_g IS NOT NULL) SELECT entity, year, sector, round({_RANKS.format(by='sector, year', v='rev_g')} / count(*) OVER (PARTITION BY sector, year), 6) AS pct FROM k",
    "peer_stats": f"WITH {SECTOR}, k AS (SELECT entity, year, sector, round(rev_g, 8) AS g FROM panel WHERE rev_g IS NOT NULL) SELECT entity, year, n, round(below, 6) AS below, round(mid, 5) AS sector_median FROM (SELECT entity, year, count(*) OVER (PARTITION BY sector, year) AS n, cume_dist() OVER (PARTITION BY sector, year ORDER BY g) AS below, median(g) OVER (PARTITION BY sector, year) AS mid FROM k) WHERE n >= 5",
    "target_next_year": f"WITH {YEARLY} SELECT y.entity, y.year, round(CASE WHEN n.revenue > 0 AND y.revenue > 0 THEN ln(n.revenue / y.revenue) END, 5) AS target, coalesce(abs(ln(n.revenue / y.revenue)) > ln(1.25::DOUBLE), false) AS jump, coalesce(n.revenue > 0, false) AND NOT coalesce(abs(ln(n.revenue / y.revenue)) > ln(1.25::DOUBLE), false) AS has_target FROM yearly y LEFT JOIN yearly n ON n.entity = y.entity AND n.year = y.year + 1",
    "group_centered": f"WITH {GROWTH}, k AS (SELECT entity, year, {_CLIP.format(x='rev_g', a=-1, b=1)} AS y FROM grown WHERE rev_g IS NOT NULL) SELECT entity, year, round(y - median(y) OVER (PARTITION BY year), 5) AS centered FROM k",
    "median_of_medians": f"WITH {SECTOR} SELECT year, round(median(m), 5) AS market FROM (SELECT sector, year, median(rev_g) AS m FROM panel WHERE rev_g IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "qcut_quintiles": f"WITH {YEARLY}, v AS (SELECT entity, year, round(revenue, 2) AS revenue FROM yearly), e AS (SELECT year, list_distinct(quantile_cont(revenue, [0.2, 0.4, 0.6, 0.8])) AS e FROM v GROUP BY 1) SELECT entity, v.year, CAST(1 + len(list_filter(e, lambda x: x < revenue)) AS INTEGER) AS bucket FROM v JOIN e ON e.year = v.year",
    "vol_bins": f"WITH {_ERRORS} SELECT vol, count(*) AS n FROM errors GROUP BY 1",
    "conformal_radius": f"WITH {_ERRORS} SELECT vol, radius FROM radii",
    "coverage_by_group": f"WITH {_ERRORS} SELECT e.vol, round(avg((err <= radius)::DOUBLE), 6) AS coverage, count(*) AS n FROM errors e JOIN radii r ON r.vol = e.vol GROUP BY 1",
    "spearman_ic": f"WITH {GROWTH}, k AS (SELECT year, round(rev_g, 8) AS g, n_orders FROM grown WHERE rev_g IS NOT NULL), ranks AS (SELECT year, {_RANKS.format(by='year', v='g')} AS a, {_RANKS.format(by='year', v='n_orders')} AS b FROM k) SELECT year, round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 5) AS ic FROM ranks GROUP BY 1 HAVING min(b) < max(b)",
    "mae_rmse_baselines": f"WITH {GROWTH}, k AS (SELECT x.year, {_CLIP.format(x='x.rev_g', a=-0.95, b=5)} AS y, {_CLIP.format(x='p.rev_g', a=-0.95, b=5)} AS g FROM grown x JOIN grown p ON p.entity = x.entity AND p.year = x.year - 1 WHERE x.rev_g IS NOT NULL AND p.rev_g IS NOT NULL) SELECT year, round(avg(abs(y - g)), 4) AS mae, round(sqrt(avg((y - g) * (y - g))), 4) AS rmse, round(1 - avg(abs(y - g)) / nullif(avg(abs(y)), 0), 4) AS improvement FROM k GROUP BY 1",
    "walk_forward_counts": f"WITH {YEARLY}, n AS (SELECT year, count(*) AS n FROM yearly GROUP BY 1) SELECT t.year AS fold, CAST(sum(p.n) AS BIGINT) AS train, any_value(t.n) AS test FROM n t JOIN n p ON p.year < t.year GROUP BY 1",
    "cagr_endpoints": f"WITH {YEARLY}, k AS (SELECT entity, min(year) AS y0, max(year) AS y1, min_by(revenue, year) AS v0, max_by(revenue, year) AS v1 FROM yearly GROUP BY 1) SELECT entity, round(CASE WHEN y1 > y0 AND v0 > 0 AND v1 > 0 THEN pow(v1 / v0, 1.0::DOUBLE / (y1 - y0)) - 1 END, 5) AS cagr FROM k",
    "latest_per_key": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "full_outer_ratios": "SELECT o_custkey, n_big, n_open FROM (SELECT o_custkey, count(*) AS n_big FROM orders WHERE o_totalprice > 200000 GROUP BY 1) FULL JOIN (SELECT o_custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (o_custkey)",
    "risk_flags": f"WITH {GROWTH}, f AS (SELECT entity, year, unnest([CASE WHEN rev_g < -0.5 THEN 'growth_drop' END, CASE WHEN n_orders = 1 THEN 'one_order_year' END, CASE WHEN revenue > 0 AND largest / revenue > 0.8 THEN 'concentrated' END]) AS flag FROM grown) SELECT * FROM f WHERE flag IS NOT NULL",
    "beneish_score": f"WITH {YEARLY}, k AS (SELECT y.entity, y.year, CASE WHEN p.revenue > 0 THEN y.revenue / p.revenue END AS sgi, CASE WHEN p.n_orders > 0 THEN y.n_orders::DOUBLE / p.n_orders END AS dsri, CASE WHEN y.revenue > 0 THEN y.largest / y.revenue END AS tata FROM yearly y LEFT JOIN yearly p ON p.entity = y.entity AND p.year = y.year - 1) SELECT entity, year, round(CASE WHEN tata IS NOT NULL AND sgi IS NOT NULL THEN -4.84 + 0.92 * CASE WHEN dsri IS NULL THEN 1.0 ELSE least(10.0, greatest(0.0, dsri)) END + 0.528 + 0.404 + 0.115 - 0.172 - 0.327 + 0.892 * least(10.0, greatest(0.0, sgi)) + 4.679 * greatest(-1.0, least(1.0, tata)) END, 5) AS m_score FROM k",
    "forecast_bounds": f"WITH {GROWTH}, v AS (SELECT *, round(stddev_samp(rev_g) OVER (PARTITION BY entity ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 8) AS s FROM grown), x AS (SELECT entity, year, round(greatest(-1::DOUBLE, least(1::DOUBLE, ln(1 + rev_g))), 8) AS g, CASE WHEN s IS NULL THEN 'none' WHEN s <= 0.05 THEN 'a' WHEN s <= 0.1 THEN 'b' WHEN s <= 0.2 THEN 'c' WHEN s <= 0.4 THEN 'd' ELSE 'e' END AS vol FROM v WHERE rev_g > -1), m AS (SELECT year, median(g) AS m FROM x GROUP BY 1), e AS (SELECT vol, abs(round(g - m, 8)) AS err FROM x JOIN m ON m.year = x.year), r AS (SELECT vol, err AS radius FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY err) AS k, count(*) OVER (PARTITION BY vol) AS n FROM e) WHERE k = least(ceil((n + 1) * 0.8::DOUBLE), n)), c AS (SELECT median(m) AS c FROM m) SELECT entity, year, round(exp(c - radius) - 1, 5) AS low, round(exp(c) - 1, 5) AS mid, round(exp(c + radius) - 1, 5) AS high FROM x JOIN r ON r.vol = x.vol, c",
    "metric_rows_format": f"WITH {YEARLY}, k AS (SELECT entity || '.concentration.' || year AS id, round(round(largest / revenue, 3) * 100, 1) AS p FROM yearly) SELECT id, replace(format('{{:.1f}}', p), '.', ',') || '%' AS vi, format('{{:.1f}}', p) || '%' AS en FROM k",
    "comparison_table": f"WITH {YEARLY}, k AS (SELECT year, " + ", ".join(f"round(sum(revenue) FILTER (entity = {k}), 2) AS e{k}" for k in (1, 2, 4)) + " FROM yearly WHERE entity IN (1, 2, 4) GROUP BY 1) SELECT year, " + ", ".join(f"coalesce(format('{{:,.0f}}', e{k}), '—') AS e{k}" for k in (1, 2, 4)) + " FROM k",
    "cluster_bootstrap": f"WITH {YEARLY}, n AS MATERIALIZED (SELECT entity, row_number() OVER (ORDER BY md5(entity::VARCHAR), entity) - 1 AS number, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM yearly)), t AS (SELECT draw, ('0x' || substr(md5(concat_ws('/', 'bootstrap', draw, number)), 1, 13))::BIGINT % n AS number, count(*) AS times FROM n, (SELECT CAST(unnest(generate_series(0, 29)) AS INTEGER) AS draw) GROUP BY ALL) SELECT draw, CAST(sum(times) AS BIGINT) AS n, round(sum(revenue * times) / sum(times), 2) AS mean FROM t JOIN n ON n.number = t.number JOIN yearly ON yearly.entity = n.entity GROUP BY 1",
    "bootstrap_times": f"WITH {YEARLY}, n AS MATERIALIZED (SELECT entity, row_number() OVER (ORDER BY md5(entity::VARCHAR), entity) - 1 AS number, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM yearly)) SELECT draw, n.entity AS unit, times FROM (SELECT draw, ('0x' || substr(md5(concat_ws('/', 'bootstrap', draw, number)), 1, 13))::BIGINT % n AS number, count(*) AS times FROM n, (SELECT CAST(unnest(generate_series(0, 29)) AS INTEGER) AS draw) GROUP BY ALL) t JOIN n ON n.number = t.number",
    "replace_by_key": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM orders",
    "union_concat": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "distinct_sets": "SELECT o_custkey, concat_ws(',', CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' END, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'O' END) AS both, concat_ws(',', CASE WHEN NOT bool_or(o_orderstatus = 'F') THEN 'F' END, CASE WHEN NOT bool_or(o_orderstatus = 'O') THEN 'O' END) AS missing FROM orders GROUP BY 1",
}
