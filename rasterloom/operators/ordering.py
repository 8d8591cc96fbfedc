"""Global order statistics that never sort everything in one task.

``Window.orderBy`` without a partition key and the exact ``percentile``
aggregate both end in a single task.  Here the order is produced by a range
shuffle; positions inside a range partition are then lifted to global ones with
one small offset per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import checkpoint

_TAKE = 5_000    # largest k for take-ordered, where one task merges k rows of every partition
_BINS = 4096
_DIGITS = 256       # bins of a power of two in the first pass of percentiles
_FINE = 1024        # bins into which a later pass cuts a wanted one
_EXACT = 2_000_000  # rows in wanted bins up to which these are counted value by value
_SORTED = 500_000   # rows of a sorted partition, where their number is known
_GROUPS = 100_000   # groups up to which a table with one row per group is broadcast
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition position here


def best_first(score: str = "p") -> list[Column]:
    """Total order of candidates: score, then row, then column, all descending."""
    return [F.col(score).desc(), F.col("row").desc(), F.col("col").desc()]


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted and checkpointed; ``_pid``/``_pos`` name the place."""
    # No partition count: AQE may merge neighbouring ranges, which keeps them ordered.
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # The id depends on the physical partition, so it has to be stored once
    # before anything joins on it.
    stored = checkpoint(ranged)
    return (stored.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
            .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_mid"))


def _offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sum of each total over all earlier partitions: one row per partition."""
    per_part = placed.groupBy("_pid").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_pid", *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Append the 1-based position of every row in ``order``."""
    placed = _ranged(df, order)
    offs = _offsets(placed, {"_before": F.count(F.lit(1))})
    # One row per shuffle partition: the broadcast cannot grow with the data.
    return (placed.join(F.broadcast(offs), "_pid")
            .withColumn(name, F.col("_before") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_before"))


def running_counts(df: DataFrame, order: Sequence[Column], counts: dict[str, str]) -> DataFrame:
    """Append inclusive running totals of integer columns in ``order``; nulls count 0.

    ``counts`` maps the new column to the column it accumulates.  The totals inside a range
    partition are taken as it is sorted, so the range shuffle is the only one.
    """
    spans = {f"_c_{new}": col for new, col in counts.items()}
    schema = StructType([*df.schema.fields, StructField("_pid", IntegerType()),
                         *(StructField(n, LongType()) for n in spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), dict.fromkeys(spans, 0)
        for batch in batches:
            sums = {}
            for name, col in spans.items():
                values = batch.column(batch.schema.get_field_index(col)).cast(pa.int64())
                sums[name] = total[name] + np.cumsum(values.fill_null(0).to_numpy(zero_copy_only=False))
                if len(values):
                    total[name] = int(sums[name][-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)),
                 *(pa.array(sums[n], pa.int64()) for n in spans)], schema.names)

    # The partition's number belongs to this very layout: stored before anything joins on it.
    placed = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    offs = _offsets(placed, {f"_o_{new}": F.max(f"_c_{new}") for new in counts})
    # One row per shuffle partition: the broadcast cannot grow with the data.
    out = placed.join(F.broadcast(offs), "_pid")
    return out.withColumns({new: F.col(f"_c_{new}") + F.col(f"_o_{new}") for new in counts}).drop(
        "_pid", *spans, *(f"_o_{new}" for new in counts))


def prefix_bound(df: DataFrame, column: str, need: int) -> float | None:
    """A value such that at least ``need`` rows are not below it; None = keep all.

    Null values are below every other.  Counts in a fixed number of bins, so only that table reaches the driver.
    """
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None or hi <= lo:
        return None
    width = (hi - lo) / _BINS
    bin_no = F.floor((F.col(column).cast("double") - F.lit(lo)) / F.lit(width))
    counts = dict(df.filter(F.col(column).isNotNull()).groupBy(bin_no.alias("b")).count().collect())  # at most _BINS + 1 rows
    total = 0
    for b in sorted(counts, reverse=True):
        total += counts[b]
        if total >= need:
            # One bin lower absorbs any rounding at the bin edge.
            return lo + (b - 1) * width if b > 0 else None
    return None


def top_k(df: DataFrame, k: int, order: Sequence[Column], rank: str | None = None,
          lead: str | None = None) -> DataFrame:
    """First ``k`` rows in ``order``; ``rank`` names an optional position column.

    Which rows come back is exact; the order in which they come is not part of the result,
    whatever ``k`` is: ask for ``rank`` where it matters.

    Small ``k`` is Spark's own take-ordered.  Beyond that a global rank is cut, so
    k rows per partition never meet in one task; ``lead`` names the numeric column
    that ``order`` starts with (descending), which then drops the certain losers
    before the range shuffle.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    limit = df.sparkSession.conf.get("spark.sql.execution.topKSortFallbackThreshold", str(_TAKE))
    if k <= min(int(limit), _TAKE):
        cut = df.orderBy(*order).limit(k)
        if rank:
            # At most _TAKE rows, already in one task after the limit.
            cut = cut.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
        return cut
    if lead:
        bound = prefix_bound(df, lead, k)
        if bound is not None:
            df = df.filter(F.col(lead) >= F.lit(bound))
    ranked = global_rank(df, order, rank or "_rank").filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def few(groups: DataFrame, n: int | None = None) -> DataFrame:
    """``groups`` (one row per group, cheap to count or ``n`` by a count before), to be broadcast if they are few enough.

    The other side then stays where it is; with more groups than that no single one is
    left to decide the join, and AQE splits those that are hot.
    """
    return F.broadcast(groups) if (groups.count() if n is None else n) <= _GROUPS else groups


def match_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row per group) on ``by``; a NULL group is a group."""
    if not by:
        return left.join(right, how=how)
    keyed = right.withColumnsRenamed({b: f"_by_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return left.join(keyed, same, how).drop(*[f"_by_{b}" for b in by])


def _bin_of(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: exponent and leading digits, signed.

    Where the logarithm of a value next to a power of two is rounded across it, the digits run
    one below or beyond their range, which is the same bin.
    """
    a = F.abs(v)
    exponent = F.greatest(F.floor(F.log2(a)), F.lit(-1074))
    digits = F.floor((a / F.pow(F.lit(2.0), exponent) - 1) * _DIGITS)
    bin_no = F.when(a == F.lit(float("inf")), F.lit(1 << 40)).otherwise((exponent + 1100) * _DIGITS + digits + 1)
    return F.when(v > 0, bin_no).when(v < 0, -bin_no).otherwise(F.lit(0))


def percentiles(df: DataFrame, value: str, qs: Sequence[float],
                by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles by selection: one row per group and q.

    One aggregation counts every value in a bin of its group; the bins' counts tell which ones
    hold a wanted rank.  Further passes look only at rows of those bins: cut finer while they
    hold more than _EXACT rows, value by value then.  Nothing is sorted or stored but
    bins, and neither a hot group nor a hot value lands in one task.  A NULL group is a
    group.  Columns: ``by``, ``q``, ``value``.
    """
    by, qs = list(by), [float(q) for q in qs]
    v = F.col(value).cast("double")
    binned = (df.filter(v.isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("_v"))    # -0.0 is 0.0
              .withColumn("_bin", _bin_of(F.col("_v"))))
    span = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    bins = checkpoint(binned.groupBy(*by, "_bin").agg(*span))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))     # bins of one group: the key space bounds them
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("_size") - 1)
    targets = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), fn(at * F.lit(q)).cast("long").alias("rank"))
                        for q in qs for side, fn in ((0, F.floor), (1, F.ceil))])
    inside = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
    open_ = checkpoint(
        bins.withColumn("_size", F.sum("_n").over(group)).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_t", F.explode(F.filter(targets, lambda t: inside(t["rank"])))).select("*", "_t.*").drop("_t"))
    done: DataFrame | None = None
    while True:
        found = open_.filter("_lo = _hi")
        done = found if done is None else done.unionByName(found)
        rest = open_.filter("_lo < _hi")
        wanted = rest.groupBy(*by, "_bin", "_lo", "_hi", "_n", "_before").agg(F.lit(1).alias("_one")).drop("_one")
        rows = wanted.agg(F.sum("_n")).first()[0]
        if rows is None:
            break
        keys = [*by, "_bin", "_from"]
        edges = wanted.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_bin").alias("_of"), F.col("_lo").alias("_from"),
                              F.col("_hi").alias("_to"), F.col("_before").alias("_start"))
        mine = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
        near = binned.join(few(edges), [*mine, F.col("_bin") == F.col("_of"), F.col("_v").between(F.col("_from"), F.col("_to"))])
        cell = (F.col("_v") if rows <= _EXACT else
                F.least(F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * _FINE), F.lit(_FINE - 1)))
        parts = near.groupBy(*keys, "_start", cell.alias("_cell")).agg(*span)
        upto = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_start", "_cell")
        asked = rest.select(*by, "_bin", F.col("_lo").alias("_from"), "_size", "q", "side", "rank")
        open_ = checkpoint(match_null_safe(parts, asked, keys).filter(inside(F.col("rank"))).select(*open_.columns))
    part = at * F.col("q") - F.floor(at * F.col("q"))
    low, high = (F.max(F.when(F.col("side") == side, F.col("_lo"))) for side in (0, 1))
    ends = done.groupBy(*by, "q").agg(low.alias("_lo"), high.alias("_hi"), F.max(part).alias("_part"))
    return ends.select(*by, "q", F.when(F.col("_part") == 0, F.col("_lo"))
                       .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def percentiles_wide(df: DataFrame, value: str, named: dict[str, float],
                     by: Sequence[str] = ()) -> DataFrame:
    """``percentiles`` with one column per name, one row per group."""
    long = percentiles(df, value, sorted(set(named.values())), by)
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(n)
        for n, q in named.items()])


def _run_starts(keys: Sequence[str], part: bool, schema: StructType):
    """Arrow function that appends the place, in its partition, of the first row with a row's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, last = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            fresh = np.zeros(n, bool)
            for c in columns:
                same = pc.equal(c.slice(1), c.slice(0, n - 1)).fill_null(False)
                both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
                fresh[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            head = tuple(c[0].as_py() for c in columns)
            starts = np.where(fresh, at + np.arange(n), -1)
            starts[0] = start if head == last else at
            starts = np.maximum.accumulate(starts)
            start, last, at = int(starts[-1]), tuple(c[n - 1].as_py() for c in columns), at + n
            extra = [pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))] if part else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, pa.array(starts)], schema.names)

    return run


def with_average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), spread: Sequence[str] = (),
                       name: str = "avg_rank", rows: int | None = None) -> DataFrame:
    """Append the average rank of ``value`` (ascending, 1-based, without nulls) within ``by``.

    Rows are range-sorted once, by ``spread`` among equal values, so a value that most rows
    share fills many partitions.  The first and the last place of a run of ties are taken while
    the sorted partition is read forwards and backwards; a run that goes on in the next
    partition is completed from one row per partition.  No join on values.

    ``rows``, where the caller knows how many there are, keeps partitions near _SORTED rows
    whatever the size of the table; they are sorted twice and what follows is their memory.
    """
    keys = [*by, value]
    order = [F.col(c).asc() for c in (*keys, *spread)]
    added = [StructField("_pid", IntegerType()), StructField("_first", LongType())]
    schema = StructType([*df.schema.fields, *added])
    parts = [] if rows is None else [max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // _SORTED))]
    placed = checkpoint(df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
                        .mapInArrow(_run_starts(keys, True, schema), schema))
    ends = F.struct(*keys)
    parts = (placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.max("_first").alias("last"),
                                        F.count(F.when(F.col("_first") == 0, 1)).alias("lead"),
                                        F.min_by(ends, "_first").alias("head"), F.max_by(ends, "_first").alias("tail"))
             .orderBy("_pid").collect())        # one row per partition
    offsets, total = [], 0
    for r in parts:
        offsets.append(total)
        total += r["n"]
    first_start, last_stop = list(offsets), [o + r["n"] for o, r in zip(offsets, parts)]
    for i in range(1, len(parts)):
        before = parts[i - 1]
        if before["tail"] == parts[i]["head"]:      # the run began there, or even earlier if it fills that partition
            first_start[i] = first_start[i - 1] if before["last"] == 0 else offsets[i - 1] + before["last"]
    for i in range(len(parts) - 2, -1, -1):
        after = parts[i + 1]
        if parts[i]["tail"] == after["head"]:       # it ends there, or even later if it fills that partition
            last_stop[i] = last_stop[i + 1] if after["last"] == 0 else offsets[i + 1] + after["lead"]
    back = [F.col(c).desc() for c in keys]
    schema_back = StructType([*schema.fields, StructField("_after", LongType())])
    ranked = placed.sortWithinPartitions(*back).mapInArrow(_run_starts(keys, False, schema_back), schema_back)
    carry = df.sparkSession.createDataFrame(
        [(r["_pid"], o, r["n"], a, b) for r, o, a, b in zip(parts, offsets, first_start, last_stop)],
        "_pid int, _offset long, _rows long, _begin long, _end long")
    begin = F.when(F.col("_first") == 0, F.col("_begin")).otherwise(F.col("_offset") + F.col("_first"))
    end = F.when(F.col("_after") == 0, F.col("_end")).otherwise(F.col("_offset") + F.col("_rows") - F.col("_after"))
    out = ranked.join(F.broadcast(carry), "_pid")       # one row per partition
    middle = (begin + end + 1) / 2
    if by:
        sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
        so_far = Window.orderBy(*[F.col(b).asc() for b in by]).rowsBetween(Window.unboundedPreceding, -1)     # one row per group
        starts = sizes.withColumn("_group", F.coalesce(F.sum("_m").over(so_far), F.lit(0))).drop("_m")
        out = match_null_safe(out, few(checkpoint(starts)), by)
        middle = middle - F.col("_group")
    return out.select(*df.columns, middle.alias(name))
