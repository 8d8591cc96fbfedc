"""Pixel tables: indexing, profiles, blocks, masks and dense write-back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import GeoRef, utm_to_lonlat
from ..functions.values import all_valid, is_invalid, normalize
from ..session import checkpoint

VALIDATION_BLOCKS = (1, 7, 9, 10)   # fixed values


@dataclass(frozen=True)
class Shape:
    height: int
    width: int

    @staticmethod
    def of(df: DataFrame) -> "Shape":
        h, w = df.agg(F.max("row") + 1, F.max("col") + 1).first()
        return Shape(int(h), int(w))


def row_of(index: Column, width: int) -> Column:
    return F.floor(index / width).cast("int")


def col_of(index: Column, width: int) -> Column:
    return (index % width).cast("int")


def flat_index(width: int) -> Column:
    return F.col("row").cast("long") * width + F.col("col")


def pixels_from_table(df: DataFrame, index: str, width: int, **columns: Column) -> DataFrame:
    """Turn a table with a dense id into pixel rows with the given value columns."""
    i = F.col(index)
    return df.select(row_of(i, width).alias("row"), col_of(i, width).alias("col"),
                     *[c.alias(n) for n, c in columns.items()])


def strip_of(rows: int = 512) -> Column:
    """Row strip number; partition written tables by it so that reads prune."""
    return F.floor(F.col("row") / rows).cast("int")


def raster_profile(df: DataFrame, bands: list[str], geo: GeoRef) -> DataFrame:
    """One row: height, width, bands, bounds, resolution, crs, transform."""
    size = df.agg((F.max("row") + 1).cast("int").alias("height"),
                  (F.max("col") + 1).cast("int").alias("width"))
    return size.select(
        "height", "width", F.lit(len(bands)).alias("bands"), F.lit(geo.left).alias("left_m"),
        (F.lit(geo.top) - F.col("height") * geo.res).alias("bottom_m"),
        (F.lit(geo.left) + F.col("width") * geo.res).alias("right_m"), F.lit(geo.top).alias("top_m"),
        F.lit(geo.res).alias("resolution"), F.lit(geo.crs).alias("crs"))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Six booleans comparing two one-row raster profiles."""
    fields = ["height", "width", "left_m", "bottom_m", "right_m", "top_m", "resolution", "crs"]
    other = b.select(F.struct(*fields)).scalar()
    same = {f: F.col(f) == other[f] for f in fields}
    return a.select(
        same["width"].alias("same_width"), same["height"].alias("same_height"),
        same["crs"].alias("same_crs"), same["resolution"].alias("same_resolution"),
        (same["left_m"] & same["right_m"] & same["top_m"] & same["bottom_m"]).alias("same_bounds"),
        (same["left_m"] & same["top_m"] & same["resolution"]).alias("same_transform"))


def band_profile(df: DataFrame, band: str, valid: str | None = None) -> DataFrame:
    """Minimum, maximum, mean of valid values and the masked count."""
    bad = is_invalid(F.col(band), "finite")
    if valid:
        bad = bad | ~F.col(valid)
    good = F.when(~bad, F.col(band))
    return df.agg(F.min(good).alias("min"), F.max(good).alias("max"), F.avg(good).alias("mean"),
                  F.count(F.when(bad, 1)).alias("masked"))


def distinct_values(df: DataFrame, band: str, n: int = 20) -> DataFrame:
    """First ``n`` distinct values in ascending order with their counts."""
    return (df.filter(~is_invalid(F.col(band), "finite")).groupBy(F.col(band).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(n))


def block_of(height: int, width: int, per_side: int = 4) -> Column:
    """Block number, row-major; the last block in each direction takes the remainder."""
    last = per_side - 1
    by = F.least(F.floor(F.col("row") / (height // per_side)), F.lit(last))
    bx = F.least(F.floor(F.col("col") / (width // per_side)), F.lit(last))
    return (by * per_side + bx).cast("int")


def block_rectangles(height: int, width: int, per_side: int = 4) -> list[tuple[int, int, int, int, int]]:
    """(block, row0, row1, col0, col1), half-open."""
    bh, bw, last = height // per_side, width // per_side, per_side - 1
    return [(i * per_side + j, i * bh, height if i == last else (i + 1) * bh,
             j * bw, width if j == last else (j + 1) * bw)
            for i in range(per_side) for j in range(per_side)]


def split_of(block: Column, validation: tuple[int, ...] = VALIDATION_BLOCKS) -> Column:
    return F.when(block.isin(*validation), F.lit("validation")).otherwise(F.lit("train"))


def border_safe(height: int, width: int, margin: int = 15) -> Column:
    """At least ``margin`` pixels from every raster edge."""
    return (F.col("row").between(margin, height - margin - 1)
            & F.col("col").between(margin, width - margin - 1))


def with_split_distance(df: DataFrame, height: int, width: int, target: tuple[int, ...],
                        name: str = "split_distance", per_side: int = 4) -> DataFrame:
    """Append the Euclidean distance in pixels to the nearest pixel of the target blocks.

    Closed form over at most per_side^2 rectangles; no join, no distance raster.
    Cells outside the raster belong to no block.  The rectangles are one constant
    array, which keeps the expression small when the optimizer copies a filter on it
    through joins.
    """
    rects = F.array(*[
        F.struct(F.lit(r0).alias("r0"), F.lit(r1 - 1).alias("r1"), F.lit(c0).alias("c0"), F.lit(c1 - 1).alias("c1"))
        for b, r0, r1, c0, c1 in block_rectangles(height, width, per_side) if b in target])

    def squared(b: Column) -> Column:
        dy = F.greatest(b["r0"] - F.col("row"), F.col("row") - b["r1"], F.lit(0)).cast("double")
        dx = F.greatest(b["c0"] - F.col("col"), F.col("col") - b["c1"], F.lit(0)).cast("double")
        return F.pow(dy, F.lit(2.0)) + F.pow(dx, F.lit(2.0))

    return df.withColumn(name, F.sqrt(F.array_min(F.transform(rects, squared))))


def stack_bands(df: DataFrame, bands: list[str], *keys: str | Column) -> DataFrame:
    """Unpivot bands to rows: keys..., band (1-based), feature, value."""
    pairs = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(b).alias("feature"),
                               F.col(b).cast("double").alias("value"))
                      for i, b in enumerate(bands, start=1)])
    return df.select(*keys, F.inline(pairs))


def band_stats(df: DataFrame, bands: list[str], mode: str = "huge") -> DataFrame:
    """Mean and population std of the valid values per band; std < 1e-8 becomes 1."""
    aggs = []
    for b in bands:
        good = F.when(~is_invalid(F.col(b), mode), F.col(b).cast("double"))
        aggs += [F.avg(good).alias(f"{b}_mean"), F.stddev_pop(good).alias(f"{b}_std")]
    one = df.agg(*aggs)
    std = {b: F.when(F.col(f"{b}_std") < 1e-8, 1.0).otherwise(F.col(f"{b}_std")) for b in bands}
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("band"), F.lit(b).alias("feature"),
                 F.col(f"{b}_mean").alias("mean"), std[b].alias("std"))
        for i, b in enumerate(bands, start=1)])))


def normalize_bands(df: DataFrame, bands: list[str], stats: DataFrame | dict[str, tuple[float, float]],
                    *, valid: str | None = None, denom: str = "max", floor: float = 1e-8,
                    on_invalid: str = "mean", mode: str = "huge") -> DataFrame:
    """Standardise bands in place.

    stats       {band: (mean, std)} or the table of ``band_stats``, which is read
                as a one-row scalar subquery
    valid       mask column: all bands 0 where it is false
    on_invalid  "mean" imputes the mean; "zero" zeroes only that band; "zero_all"
                zeroes every band of a pixel with any invalid band; "keep" is "mean"
    """
    if isinstance(stats, dict):
        mean = {b: F.lit(float(stats[b][0])) for b in bands}
        std = {b: F.lit(float(stats[b][1])) for b in bands}
    else:
        # One struct for all bands, read once per row instead of once per band.
        one = stats.agg(*[F.max(F.when(F.col("feature") == b, F.struct("mean", "std"))).alias(b)
                          for b in bands])
        df = df.withColumn("_stats", one.select(F.struct(*bands)).scalar())
        mean = {b: F.col("_stats")[b]["mean"] for b in bands}
        std = {b: F.col("_stats")[b]["std"] for b in bands}
    ok = F.lit(True)
    if valid:
        ok = F.coalesce(F.col(valid), F.lit(False))
    if on_invalid == "zero_all":
        ok = ok & all_valid(bands, mode)
    per_band = "zero" if on_invalid == "zero" else "mean"
    z = {b: F.when(ok, normalize(F.col(b), mean[b], std[b], denom=denom, floor=floor,
                                 on_invalid=per_band, mode=mode)).otherwise(F.lit(0.0))
         for b in bands}
    return df.withColumns(z).drop("_stats")


def impute_group_median(df: DataFrame, bands: list[str], group: str, mode: str = "huge") -> DataFrame:
    """Replace invalid values by the group's own median, 0 if the group has none."""
    from .ordering import few, percentiles
    long = stack_bands(df, bands, group).filter(~is_invalid(F.col("value"), mode))
    med = (percentiles(long, "value", [0.5], ["feature", group])
           .groupBy(group).agg(*[F.max(F.when(F.col("feature") == b, F.col("value"))).alias(f"_m_{b}")
                                 for b in bands]))
    # A null group is a group, as in the percentiles.
    med = few(checkpoint(med.withColumnRenamed(group, "_group")))
    joined = df.join(med, df[group].eqNullSafe(med["_group"]), "left").drop("_group")
    return joined.withColumns({
        b: F.when(is_invalid(F.col(b), mode), F.coalesce(f"_m_{b}", F.lit(0.0))).otherwise(F.col(b))
        for b in bands}).drop(*[f"_m_{b}" for b in bands])


def ablations(df: DataFrame, bands: list[str], first: int = 1) -> DataFrame:
    """Every pixel once per band with that normalised band set to 0; adds ``ablated`` (``first=0``: and once unchanged)."""
    out = df.withColumn("ablated", F.explode(F.sequence(F.lit(first), F.lit(len(bands)))))
    return out.withColumns({b: F.when(F.col("ablated") == i, F.lit(0.0)).otherwise(F.col(b))
                            for i, b in enumerate(bands, start=1)})


def with_lonlat(df: DataFrame, geo: GeoRef) -> DataFrame:
    """Append x, y (pixel centre, metres), longitude, latitude."""
    placed = df.withColumn("x", geo.x(F.col("col"))).withColumn(
        "y", geo.y(F.col("row")))
    lon, lat = utm_to_lonlat(F.col("x"), F.col("y"), geo.zone)
    return placed.withColumn("longitude", lon).withColumn("latitude", lat)


def raster_corners(profile: DataFrame, geo: GeoRef) -> DataFrame:
    """Longitude and latitude of the four outer corners of a raster profile."""
    corner = F.explode(F.array(*[
        F.struct(F.lit(n).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"))
        for n, x, y in (("top_left", "left_m", "top_m"), ("top_right", "right_m", "top_m"),
                        ("bottom_right", "right_m", "bottom_m"), ("bottom_left", "left_m", "bottom_m"))]))
    flat = profile.select(corner.alias("c")).select("c.*")
    lon, lat = utm_to_lonlat(F.col("x"), F.col("y"), geo.zone)
    return flat.select("corner", lon.alias("longitude"), lat.alias("latitude"))


def fill_grid(grid: DataFrame, sparse: DataFrame, value: str = "p") -> DataFrame:
    """Write a sparse result back to every grid pixel, 0 where nothing was selected."""
    return (grid.select("row", "col").join(sparse.select("row", "col", value), ["row", "col"], "left")
            .select("row", "col", F.coalesce(value, F.lit(0.0)).alias(value)))


def mask_out(pred: DataFrame, coords: DataFrame) -> DataFrame:
    """Prediction 0 outside the coordinate set."""
    inside = coords.select("row", "col", F.lit(True).alias("_in"))
    return (pred.join(inside, ["row", "col"], "left")
            .withColumn("p", F.when(F.col("_in"), F.col("p")).otherwise(F.lit(0.0))).drop("_in"))


def truth_at(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """Truth at the canonical coordinates only; every other labelled pixel is ignored."""
    return (coords.select("row", "col").join(labels.select("row", "col", "label"), ["row", "col"], "left")
            .select("row", "col", (F.coalesce("label", F.lit(0)) > 0).cast("int").alias("g")))


def neighbour(df: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """Stencil join: value at (row+dy, col+dx) for each pixel and offset, 0 when absent."""
    from ..functions.kernels import offset_array
    want = df.select("row", "col", F.explode(offset_array([(a, b, 1.0) for a, b in offsets])).alias("o"))
    want = want.select(F.col("row").alias("c_row"), F.col("col").alias("c_col"),
                       F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx"),
                       (F.col("row") + F.col("o.dy")).alias("row"),
                       (F.col("col") + F.col("o.dx")).alias("col"))
    return (want.join(df.select("row", "col", value), ["row", "col"], "left")
            .select(F.col("c_row").alias("row"), F.col("c_col").alias("col"), "dy", "dx",
                    F.coalesce(value, F.lit(0.0)).alias("near")))
