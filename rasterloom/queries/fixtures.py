"""Rasters derived from the test tables, in Spark and as SQL text.

grid    orders laid out by order key: p from the price, g from the priority
bands   grid with five bands (line-item aggregates and the customer balance);
        orders without line items are natural NoData
grid2   events laid out the same way: a second raster
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import SURVEY_GEO, UTM_FALSE_EASTING, UTM_SCALE, WGS84_A, WGS84_F
from ..operators.grid import Shape, pixels_from_table, with_lonlat

BANDS = ["b1", "b2", "b3", "b4", "b5"]
GEO = SURVEY_GEO
WIDTH = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shape(spark: SparkSession, sf: str) -> Shape:
    """WIDTH columns and as many rows as the orders need; the count reads only file footers."""
    n = table(spark, sf, "orders").count()
    return Shape(-(-n // WIDTH), WIDTH)


def grid(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    size = size or shape(spark, sf)
    return pixels_from_table(
        table(spark, sf, "orders"), "o_orderkey", size.width,
        p=F.col("o_totalprice") / 500000.0,
        g=F.col("o_orderpriority").startswith("1").cast("int"),
        valid=F.col("o_orderstatus") != "P")


def truth(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    return grid(spark, sf, size).filter("g > 0").select("row", "col")


def bands(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    """Sums are taken in whole cents, so both engines get the same doubles."""
    size = size or shape(spark, sf)

    def mean_cents(c: str):
        return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (100.0 * F.count(F.lit(1)))

    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("b1"),
        mean_cents("l_extendedprice").alias("b2"), mean_cents("l_discount").alias("b3"),
        mean_cents("l_tax").alias("b4"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.join(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b5")),
               F.col("o_custkey") == F.col("c_custkey"), "left")
    return pixels_from_table(
        o, "o_orderkey", size.width, p=F.col("o_totalprice") / 500000.0,
        g=F.col("o_orderpriority").startswith("1").cast("int"),
        valid=F.col("o_orderstatus") != "P", **{b: F.col(b) for b in BANDS})


def other(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    """A second score for every pixel of ``grid``: the customer's balance."""
    size = size or shape(spark, sf)
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
                                        F.col("o_custkey") == F.col("c_custkey"), "left")
    return pixels_from_table(o, "o_orderkey", size.width,
                             p=F.coalesce(F.greatest(F.col("c_acctbal") / 10000.0, F.lit(0.0)), F.lit(0.0)))


def grid2(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    size = size or shape(spark, sf)
    return pixels_from_table(
        table(spark, sf, "events"), "event_id", size.width,
        p=F.least(F.col("value") / 500.0, F.lit(1.0)),
        g=(F.col("event_type") == "error").cast("int"))


def points(spark: SparkSession, sf: str, size: Shape | None = None) -> DataFrame:
    return with_lonlat(grid(spark, sf, size), GEO)


def six(df: DataFrame, *cols: str) -> DataFrame:
    """Round derived floating columns to six decimals for comparison."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# --- SQL text ------------------------------------------------------------------------

CTE = {
    "w": f"w AS (SELECT {WIDTH} AS width)",
    "grid": '''grid AS (SELECT CAST(o_orderkey // width AS INTEGER) AS "row",
        CAST(o_orderkey % width AS INTEGER) AS col, o_totalprice / 500000e0 AS p,
        CAST(o_orderpriority LIKE '1%' AS INTEGER) AS g, o_orderstatus <> 'P' AS valid
        FROM orders, w)''',
    "size": 'size AS (SELECT (count(*) + max(width) - 1) // max(width) AS h, CAST(max(width) AS BIGINT) AS wd FROM orders, w)',
    "bands": '''lines AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS b1,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100e0 * count(*)) AS b2,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100e0 * count(*)) AS b3,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / (100e0 * count(*)) AS b4
        FROM lineitem GROUP BY l_orderkey),
      bands AS (SELECT CAST(o_orderkey // width AS INTEGER) AS "row",
        CAST(o_orderkey % width AS INTEGER) AS col, o_totalprice / 500000e0 AS p,
        CAST(o_orderpriority LIKE '1%' AS INTEGER) AS g, o_orderstatus <> 'P' AS valid,
        b1, b2, b3, b4, c_acctbal AS b5
        FROM orders CROSS JOIN w LEFT JOIN lines ON l_orderkey = o_orderkey
        LEFT JOIN customer ON c_custkey = o_custkey)''',
    "grid2": '''grid2 AS (SELECT CAST(event_id // width AS INTEGER) AS "row",
        CAST(event_id % width AS INTEGER) AS col, least(value / 500e0, 1e0) AS p,
        CAST(event_type = 'error' AS INTEGER) AS g FROM events, w)''',
    "other": '''other AS (SELECT CAST(o_orderkey // width AS INTEGER) AS "row",
        CAST(o_orderkey % width AS INTEGER) AS col, coalesce(greatest(c_acctbal / 10000e0, 0e0), 0e0) AS p
        FROM orders CROSS JOIN w LEFT JOIN customer ON c_custkey = o_custkey)''',
    "truth": 'truth AS (SELECT "row", col FROM grid WHERE g > 0)',
    "xy": f'''xy AS (SELECT *, {GEO.left}e0 + (col + 0.5e0) * {GEO.res}e0 AS x,
        {GEO.top}e0 - ("row" + 0.5e0) * {GEO.res}e0 AS y FROM grid)''',
    # Long form of the five bands.
    "long": "long AS (" + " UNION ALL ".join(
        f'SELECT "row", col, p, g, valid, {i} AS band, \'{b}\' AS feature, {b} AS value FROM bands'
        for i, b in enumerate(BANDS, 1)) + ")",
}


def sql_lonlat(source: str, name: str = "points", zone: int = 11) -> str:
    """CTE text: inverse UTM of ``source`` (columns x, y) by the Krueger series."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi = "".join(f" - {b!r} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, b in enumerate(beta, 1))
    eta = "".join(f" - {b!r} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, b in enumerate(beta, 1))
    lat = "".join(f" + {d!r} * sin({2*j} * chi)" for j, d in enumerate(delta, 1))
    return f'''{name}_1 AS (SELECT *, y / {UTM_SCALE * a!r} AS xi,
          (x - {UTM_FALSE_EASTING!r}) / {UTM_SCALE * a!r} AS eta FROM {source}),
      {name}_2 AS (SELECT *, xi{xi} AS xi_c, eta{eta} AS eta_c FROM {name}_1),
      {name}_3 AS (SELECT *, asin(sin(xi_c) / cosh(eta_c)) AS chi FROM {name}_2),
      {name} AS (SELECT * EXCLUDE (xi, eta, xi_c, eta_c, chi),
          degrees({math.radians(zone * 6 - 183)!r} + atan2(sinh(eta_c), cos(xi_c))) AS longitude,
          degrees(chi{lat}) AS latitude FROM {name}_3)'''


CTE["points"] = sql_lonlat("xy")


def values_offsets(offsets, name: str = "o") -> str:
    rows = ", ".join(f"({dy}, {dx}, {float(w)!r}::DOUBLE)" for dy, dx, w in offsets)
    return f"{name}(dy, dx, k) AS (VALUES {rows})"


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """WITH clause from named or literal parts, dependencies included, then the body."""
    needs = {"grid": ["w"], "size": ["w"], "bands": ["w"], "grid2": ["w"], "other": ["w"], "truth": ["grid"],
             "xy": ["grid"], "points": ["xy"], "long": ["bands"]}
    seen: list[str] = []

    def add(p: str) -> None:
        for d in needs.get(p, []):
            add(d)
        if p not in seen:
            seen.append(p)

    for p in parts:
        add(p)
    head = "WITH " + ("RECURSIVE " if recursive else "")
    return head + ",\n      ".join(CTE.get(p, p) for p in seen) + "\n" + body


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
