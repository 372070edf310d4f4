"""Round trips: tables written in each format, read back by the readers, and held against what was written."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.tables import parquet, scratch
from ..sources.versions import Versions


def _orders(spark, d) -> DataFrame:
    """entity, year, n, total: orders of each customer and year."""
    o = parquet(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def text_tree_files(spark, d):
    """Reports of ten nations' customers as files under entity, year and name; texts with bytes that aren't UTF-8, hashes of the bytes."""
    c = parquet(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("sum")).where("c_nationkey < 10")
    root = scratch(spark)
    for r in c.orderBy("c_nationkey").collect():  # ten rows
        stem = ("BCTC_Hop_nhat", "BCTC_Cong_ty_me", "report")[r["c_nationkey"] % 3]
        text = f"Nation {r['c_nationkey']}: {r['n']} customers"
        _put(spark, posixpath.join(root, f"E{r['c_nationkey']}", "2020", stem, "x.txt"), text.encode() + (b"\xff" if r["c_nationkey"] % 2 else b""))
    return T.text_tree(spark, root).select("entity", "year", "stem", "name_scope", "text", F.length("sha256").alias("hash"))


def _put(spark, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def csv_roundtrip(spark, d):
    """Two files of forecasts, of which the later is read."""
    root, x = scratch(spark), _orders(spark, d).coalesce(1)
    for name, df in (("p_2023", x.where("year < 1995")), ("p_2024", x.where("year >= 1995"))):
        T.to_csv(df, f"{root}/{name}")
    # one part each: named as the reader's pattern wants them
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("p_2023", "p_2024"):
        (part,) = [s.getPath() for s in fs.listStatus(path(f"{root}/{name}")) if s.getPath().getName().endswith(".csv")]
        fs.rename(part, path(f"{root}/{name}.csv"))
    return T.latest_csv(spark, root, "p_*.csv", "entity long, year int, n long, total double")


def json_roundtrip(spark, d):
    """Customers as lines of JSON, with a list and a field that some lack."""
    path = scratch(spark)
    c = parquet(spark, d, "customer")
    T.to_json(c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey"), F.col("c_custkey") % 7).alias("pages"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("lang")), path)
    x = T.json_lines(spark, path, "id long, pages array<long>, lang string")
    return x.select("id", F.col("pages")[0].alias("first"), F.col("pages")[1].alias("second"), "lang")


def sql_with_parameters(spark, d):
    """Orders of a year and a state, asked for by parameters."""
    parquet(spark, d, "orders").createOrReplaceTempView("asked_orders")
    return T.query(spark, "SELECT o_orderkey, o_custkey FROM asked_orders WHERE year(o_orderdate) = :year AND o_orderstatus = :state", year=1995, state="F")


def built_by_year(spark, d):
    """The four tables of a build, by year; rows of each and year read back from the folders."""
    root, x = scratch(spark), _orders(spark, d).withColumn("file", F.concat_ws("-", "entity", "year"))
    T.built(x.where("n > 1"), x, x.select("file", "total"), x.where("entity % 2 = 0"), x.where("n > 2"), root)
    out = None
    for name in ("reports", "facts", "fundamentals", "panel"):
        one = spark.read.parquet(f"{root}/{name}").groupBy("year").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "year", "n")
        out = one if out is None else out.unionByName(one)
    return out


def rebuilt_and_upserted(spark, d):
    """Customers and their yearly orders as one store: rebuilt, two upserts and a deletion, each of both tables at once."""
    store, x = Versions(spark, scratch(spark)), _orders(spark, d)
    c = parquet(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"))
    at = store.commit(store.at(), upsert={"customers": (c, ["entity"]), "orders": (x, ["entity"])})
    for k in (3, 5):
        new = F.col("entity") % k == 0
        at = store.commit(at, upsert={"customers": (c.where(new).withColumn("nation", F.col("nation") + 100 * k), ["entity"]), "orders": (x.where(new & (F.col("year") > 1994)), ["entity"])})
    at = store.commit(at, delete={"customers": c.where("entity % 7 = 0"), "orders": c.where("entity % 7 = 0")})
    o = at.read("orders").groupBy("entity").agg(F.sum("n").alias("n"))
    return at.read("customers").join(o, "entity", "left").select("entity", "nation", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (text_tree_files, csv_roundtrip, json_roundtrip, sql_with_parameters, built_by_year, rebuilt_and_upserted)}

_ORDERS = "x AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"
ORACLES = {
    "text_tree_files": "SELECT 'E' || c_nationkey AS entity, CAST(2020 AS INTEGER) AS year, ['BCTC_Hop_nhat', 'BCTC_Cong_ty_me', 'report'][CAST(c_nationkey % 3 + 1 AS INTEGER)] AS stem, ['consolidated', 'parent', 'unknown'][CAST(c_nationkey % 3 + 1 AS INTEGER)] AS name_scope, 'Nation ' || c_nationkey || ': ' || count(*) || ' customers' || CASE WHEN c_nationkey % 2 = 1 THEN '�' ELSE '' END AS text, CAST(64 AS INTEGER) AS hash FROM customer WHERE c_nationkey < 10 GROUP BY c_nationkey",
    "csv_roundtrip": f"WITH {_ORDERS} SELECT * FROM x WHERE year >= 1995",
    "json_roundtrip": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS first, c_custkey % 7 AS second, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS lang FROM customer",
    "sql_with_parameters": "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F'",
    "built_by_year": f"WITH {_ORDERS} " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", year, count(*) AS n FROM x WHERE {w} GROUP BY 2" for t, w in (("reports", "true"), ("facts", "n > 1"), ("fundamentals", "entity % 2 = 0"), ("panel", "n > 2"))),
    "rebuilt_and_upserted": f"WITH {_ORDERS} SELECT c_custkey AS entity, c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 500 WHEN c_custkey % 3 = 0 THEN 300 ELSE 0 END AS nation, CAST(coalesce(sum(n) FILTER ((c_custkey % 3 > 0 AND c_custkey % 5 > 0) OR year > 1994), 0) AS BIGINT) AS n FROM customer LEFT JOIN x ON entity = c_custkey WHERE c_custkey % 7 > 0 GROUP BY c_custkey, c_nationkey",
}
