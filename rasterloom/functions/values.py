"""Cleaning and display expressions on single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

HUGE = 1e30          # magnitudes above this are sentinels (fixed value)
SENTINEL = -3e38     # NoData fill sits near -3.40282e38 (fixed value)


def non_finite(x: Column) -> Column:
    """NULL, NaN or infinite."""
    x = x.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def is_invalid(x: Column, mode: str = "huge", nodata: float | None = None) -> Column:
    """Invalid-value test in four strengths.

    finite   - NULL, NaN, infinite
    huge     - the above, or magnitude over 1e30
    nodata   - the first, or equal to ``nodata``
    sentinel - the first, or at most -3e38
    """
    base = non_finite(x)
    x = x.cast("double")
    if mode == "finite":
        return base
    if mode == "huge":
        return base | (F.abs(x) > F.lit(HUGE))
    if mode == "nodata":
        if nodata is None:
            raise ValueError("mode 'nodata' needs the nodata value")
        return base | (x == F.lit(nodata))
    if mode == "sentinel":
        return base | (x <= F.lit(SENTINEL))
    raise ValueError(f"unknown mode {mode!r}")


def all_valid(bands: list[str], mode: str = "huge") -> Column:
    return reduce(lambda a, b: a & b, [~is_invalid(F.col(b), mode) for b in bands])


def sanitize(p: Column) -> Column:
    """NaN or NULL to 0, +Inf to 1, -Inf to 0, then clip to [0, 1]."""
    p = F.when(p.isNull() | F.isnan(p), F.lit(0.0)).otherwise(p)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def power_after(p: Column, power: Column, threshold: Column) -> Column:
    """p^power, then zero below the threshold."""
    q = F.pow(p, power)
    return F.when(q >= threshold, q).otherwise(F.lit(0.0))


def power_before(p: Column, power: Column, threshold: Column) -> Column:
    """Zero where raw p is below the threshold, p^power elsewhere."""
    return F.when(p >= threshold, F.pow(p, power)).otherwise(F.lit(0.0))


def normalize(x: Column, mean: Column, std: Column, *, denom: str = "max",
              floor: float = 1e-8, clip: float = 10.0, on_invalid: str = "mean",
              mode: str = "huge") -> Column:
    """Standardise one band.

    denom       "max": max(std, floor); "add": std + floor
    on_invalid  "mean": impute the band mean (so 0 unless floor bends it);
                "zero": 0 after clipping
    """
    bad = is_invalid(x, mode)
    filled = F.when(bad, mean).otherwise(x.cast("double"))
    scale = F.greatest(std, F.lit(floor)) if denom == "max" else std + F.lit(floor)
    z = F.least(F.greatest((filled - mean) / scale, F.lit(-clip)), F.lit(clip))
    return F.when(bad, F.lit(0.0)).otherwise(z) if on_invalid == "zero" else z


def stretch_byte(x: Column, low: Column, high: Column, mode: str = "huge") -> Column:
    """Linear stretch of [low, high] to 0..255, truncated; invalid values give 0."""
    top = F.when(high <= low, low + F.lit(1e-6)).otherwise(high)
    clipped = F.least(F.greatest(x.cast("double"), low), top)
    byte = F.floor((clipped - low) / (top - low) * F.lit(255.0)).cast("int")
    return F.when(is_invalid(x, mode), F.lit(0)).otherwise(byte)


def log_display(p: Column, valid: Column, floor: float = 1e-6) -> Column:
    """log10 with a floor; NULL outside the mask."""
    return F.when(valid, F.log10(F.greatest(p, F.lit(floor))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


#: Names used when a band carries no description (fixed values).
FALLBACK_BANDS = [
    "mag_anom", "rtp", "tmi_hg", "geod_2ndinv", "iso_grav_anom_slope", "tc",
    "geod_shearrate", "geod_dilaterate", "tmi_vg",
]


def clean_band_name(name: Column, index: Column) -> Column:
    """Lower-case identifier from a free-text band description.

    A missing or empty description takes the 1-based fallback name, or
    ``band_NN`` past the end of that list.
    """
    fallback = F.coalesce(
        F.get(F.array(*[F.lit(b) for b in FALLBACK_BANDS]), index - 1),
        F.concat(F.lit("band_"), F.lpad(index.cast("string"), 2, "0")))
    text = F.translate(F.translate(F.lower(F.trim(name)), " -/.", "____"), "()", "")
    text = F.regexp_replace(text, "_+", "_")
    text = F.regexp_replace(text, "^_|_$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", fallback).otherwise(text)


def display_name(name: Column) -> Column:
    """``mag_total_field`` -> ``MAG \u2014 Total Field``; no underscore: unchanged."""
    head = F.upper(F.substring_index(name, "_", 1))
    tail = F.regexp_replace(name, "^[^_]*_", "")
    tail = F.regexp_replace(F.translate(tail, "_", " "), r"\s+", " ")
    words = F.transform(F.split(tail, r"(?<=\W)(?=\w)"),
                        lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                           F.substring(w, 2, 1 << 20)))
    titled = F.array_join(words, "")
    return F.when(F.instr(name, "_") == 0, name).otherwise(
        F.concat(head, F.lit(" \u2014 "), titled))


def error_class(selected: Column, truth: Column, inside: Column) -> Column:
    """1 true positive, 2 false positive, 3 false negative, 0 rest; NULL outside."""
    code = (F.when(selected & truth, F.lit(1))
            .when(selected & ~truth, F.lit(2))
            .when(~selected & truth, F.lit(3))
            .otherwise(F.lit(0)))
    return F.when(inside, code)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-decimal text."""
    return F.format_string(f"%.{digits}f", x)
