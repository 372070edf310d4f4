"""Grades and scope of reports, the best report of each entity and year, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fold, holds
from .windows import first_per_group

#: Identities hold within this share of the larger amount.
TOLERANCE = 0.005
#: Least shares of key labels. Fixed values.
LABELS = {"BS": 0.6, "IS": 0.8, "CF": 0.6}
# Names of files that say whose accounts they hold, over folded text. Fixed values.
CONSOLIDATED_NAME = r"hop ?nhat|hopnhat|consolidat|(?<![a-z])hn(?![a-z])"
PARENT_NAME = r"cong ?ty ?me|congtyme|rieng|separate|tong ?hop|(?<![a-z])me(?![a-z])"


def name_scope(stem: Column) -> Column:
    """consolidated, parent or unknown, from the name of a file."""
    name = fold(F.translate(stem, "_-.", "   "))
    return F.when(name.rlike(CONSOLIDATED_NAME), "consolidated").when(name.rlike(PARENT_NAME), "parent").otherwise("unknown")


def graded(reports: DataFrame, entity: str = "entity") -> DataFrame:
    """reports with bs_ok, is_ok, cf_ok, corporate, scope, quality.

    An entity that ever reports consolidated figures is a group: its other reports are the parent's. A missing title is
    no consolidated title.
    """
    ok = lambda err, kind: holds(F.col(err) <= TOLERANCE) & holds(F.col(f"label_{kind}") >= LABELS[kind])
    x = reports.withColumns({"bs_ok": ok("err_balance", "BS"), "is_ok": ok("err_gross", "IS"), "cf_ok": ok("err_cash", "CF")})
    x = x.withColumn("corporate", holds(F.col("label_IS") >= LABELS["IS"]) & holds(F.col("label_BS") >= LABELS["BS"]))
    whole = (F.col("name_scope") == "consolidated") | ((F.col("name_scope") == "unknown") & holds(F.col("consolidated_title")))
    group = F.max(whole).over(Window.partitionBy(entity))
    x = x.withColumn("scope", F.when(whole, "consolidated").when(group, "parent").otherwise("single"))
    return x.withColumn("quality", sum(F.col(f"{k}_ok").cast("int") for k in ("bs", "is", "cf")))


def selected(reports: DataFrame, entity: str = "entity") -> DataFrame:
    """One corporate report for each entity and year: not a parent's, then by quality, not English, most lines, file name."""
    lines = F.col("n_BS") + F.col("n_IS") + F.col("n_CF")
    order = [F.when(F.col("scope") == "parent", 1).otherwise(0), F.desc("quality"), F.col("english"), lines.desc(), F.col("file")]
    return first_per_group(reports.where("corporate"), [entity, "year"], order)


def coverage(reports: DataFrame, entity: str = "entity") -> DataFrame:
    """By year: reports, entities, and the shares that pass each check."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return reports.groupBy("year").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct(entity).alias("entities"), *map(share, ("bs_ok", "is_ok", "cf_ok", "corporate")))
