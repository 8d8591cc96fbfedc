"""Pixel tables, candidate files, GeoJSON and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.geo import GeoRef
from ..functions.values import fixed
from ..operators.grid import strip_of

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()), T.StructField("row", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("raw_model_probability", T.DoubleType()),
    T.StructField("ranking_score", T.DoubleType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType()),
])

#: Column -> decimals of the full candidate file (fixed values).
FULL_FORMAT = {"raw_model_probability": 9, "ranking_score": 9, "x": 3, "y": 3,
               "longitude": 8, "latitude": 8}
#: Column -> decimals of the reduced file (fixed values).
REDUCED_FORMAT = {"latitude": 8, "longitude": 8, "prediction": 8}
#: Column -> decimals of the search export (fixed values).
SEARCH_FORMAT = {"score": 6, "distance_km": 4, "latitude": 6, "longitude": 6}

GEOJSON_SCHEMA = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    T.StructField("properties", T.StructType([
        T.StructField("rank", T.IntegerType()), T.StructField("row", T.IntegerType()),
        T.StructField("column", T.IntegerType()), T.StructField("score", T.DoubleType()),
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))])))])


def write_strips(pixels: DataFrame, path: str, rows: int = 512) -> None:
    """Write a pixel table partitioned by row strip, sorted so that column statistics prune."""
    keyed = pixels.withColumn("strip", strip_of(rows))
    (keyed.repartition("strip", F.floor(F.col("col") / rows)).sortWithinPartitions("row", "col")
     .write.mode("overwrite").partitionBy("strip").parquet(path))


def read_strips(spark: SparkSession, path: str, row0: int, row1: int, rows: int = 512) -> DataFrame:
    """Rows [row0, row1): only the strips that overlap are listed and read."""
    return spark.read.parquet(path).filter(
        F.col("strip").between(row0 // rows, (row1 - 1) // rows)
        & (F.col("row") >= row0) & (F.col("row") < row1))


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_candidates(spark: SparkSession, path: str,
                    required: Sequence[str] = tuple(CANDIDATE_SCHEMA.names)) -> DataFrame:
    """Candidate CSV with a header; raises when a required column is absent.

    Only the header line is looked at to check names; columns are then cast to
    the fixed schema.
    """
    df = require_columns(spark.read.option("header", True).csv(path), required)
    types = {f.name: f.dataType for f in CANDIDATE_SCHEMA}
    return df.select(*[F.col(c).cast(types.get(c, T.StringType())).alias(c) for c in df.columns])


def format_columns(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Render the named columns with a fixed number of decimals."""
    return df.withColumns({c: fixed(F.col(c), d) for c, d in decimals.items() if c in df.columns})


def candidate_export(candidates: DataFrame) -> DataFrame:
    """Full candidate file layout: 9-decimal scores, 3-decimal metres, 8-decimal degrees."""
    return format_columns(candidates.select(*CANDIDATE_SCHEMA.names), FULL_FORMAT)


def reduced_export(candidates: DataFrame) -> DataFrame:
    """rank, row, column, latitude, longitude, prediction with 8 decimals."""
    slim = candidates.select("rank", "row", "column", "latitude", "longitude",
                             F.col("raw_model_probability").alias("prediction"))
    return format_columns(slim, REDUCED_FORMAT)


def product_export(candidates: DataFrame) -> DataFrame:
    """rank, row, column, score, x, y, longitude, latitude at full precision."""
    return candidates.select("rank", "row", "column", F.col("ranking_score").alias("score"), "x", "y",
                             "longitude", "latitude")


def search_export(hits: DataFrame) -> DataFrame:
    """rank, score, distance_km, latitude, longitude, row, column as exported by the search."""
    return format_columns(hits.select("rank", "score", "distance_km", "latitude", "longitude", "row",
                                      "column"), SEARCH_FORMAT)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with header; ``order`` range-sorts the files so that reading them in name
    order gives the rows in order without a single-task sort."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)


def error_points(flagged: DataFrame, error: int, *extra: str) -> DataFrame:
    """Point table of one error class (1 TP, 2 FP, 3 FN)."""
    return flagged.filter(F.col("error") == error).select("row", "col", *extra)


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Candidate FeatureCollections to rows: rank, row, column, score, x, y, lon/lat.

    ``lines``: one collection a line, as ``write_geojson`` stores them, so that files are split.
    """
    return flatten_features(spark.read.schema(GEOJSON_SCHEMA).option("multiLine", not lines).json(path))


def write_geojson(candidates: DataFrame, path: str, size: int = 1000) -> None:
    """FeatureCollections of at most ``size`` candidates in rank order, one a line."""
    chunk = F.floor((F.col("rank") - 1) / size).alias("chunk")
    features = to_features(candidates).select(chunk, F.struct("rank", "feature").alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['),
                    F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["feature"]), ","), F.lit("]}"))
    features.groupBy("chunk").agg(text.alias("value")).select("value").write.mode("overwrite").text(path)


def flatten_features(collections: DataFrame) -> DataFrame:
    f = collections.select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("longitude"),
                    F.col("f.geometry.coordinates")[1].alias("latitude"))


def to_features(candidates: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per candidate (line-delimited, so no row is collected)."""
    return candidates.select("rank", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("rank", "row", "column", F.col("ranking_score").alias("score"), "x", "y")
        .alias("properties"))).alias("feature"))


def layer_metadata(profile: DataFrame, corners: DataFrame, layers: Sequence[tuple[int, str, str]],
                   source: str, geo: GeoRef) -> DataFrame:
    """One JSON row: source, crs, source_crs, width, height, resolution, corners, layers."""
    names = {"top_left": "topLeft", "top_right": "topRight",
             "bottom_right": "bottomRight", "bottom_left": "bottomLeft"}
    c = corners.agg(F.struct(*[
        F.max(F.when(F.col("corner") == k, F.array("longitude", "latitude"))).alias(v)
        for k, v in names.items()]).alias("c")).scalar()
    rows = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(n).alias("name"),
                              F.lit(d).alias("description"), F.lit(f"{n}.png").alias("file"))
                     for i, n, d in layers])
    return profile.select(F.to_json(F.struct(
        F.lit(source).alias("source"), F.lit("EPSG:4326").alias("crs"),
        F.col("crs").alias("source_crs"), "width", "height",
        F.array("resolution", "resolution").alias("resolution"),
        c.alias("corners"), rows.alias("layers"))).alias("metadata"))


def read_layer_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per layer of a metadata file, with the raster fields repeated."""
    meta = spark.read.option("multiLine", True).json(path)
    return meta.select("source_crs", "width", "height", F.explode("layers").alias("l")).select(
        "source_crs", "width", "height", "l.index", "l.name", "l.description", "l.file")


def run_record(selected: DataFrame, **settings: str | int | float) -> DataFrame:
    """One-row run configuration with the selected count; write it with ``write.json``."""
    return selected.agg(F.count(F.lit(1)).alias("selected")).select(
        *[F.lit(v).alias(k) for k, v in settings.items()], "selected")
