"""Ordered computations that stay parallel inside one hot group.

A plain window partitioned by page or document sorts the whole group in one
task.  The helpers here cut a group into buckets that follow its sort order,
do the ordered work per bucket, and carry only one summary row per bucket
across bucket borders.

Row numbers and medians take their buckets from the data: a sample of the
places that occur gives the borders, so gaps, crowded values and groups of any
size are cut evenly.  Other helpers take a bucket of a dense position, which
must be non-decreasing along the order and not null, as must their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096
_B = "_bucket"


def int_bucket(col: Column | str, width: int = BUCKET_ROWS) -> Column:
    """Bucket number of an integer order column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def _preceding(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)


#: Ranges into which the places of a table are cut, and how many of them share a fence of the search.
RANGES, FENCE = 1024, 32


def with_ranges(df: DataFrame, cols: Sequence[Column], ranges: int = RANGES) -> DataFrame:
    """Cut the places of a table (ascending columns, nulls first) into ranges.

    Adds ``_bucket``, the number of the range, and ``_lower`` and ``_upper``, the borders (as structs ``_0``, ``_1``
    ...) from which and below which it lies, null at the ends.  Borders are places of the table itself: of each class
    of hash values the place with the least hash.  That is a sample of the distinct places, the same in every
    evaluation, of ``ranges`` places at most.  Equal places are never separated.
    """
    place = F.struct(*[c.alias(f"_{n}") for n, c in enumerate(cols)])
    sample = (
        df.select(place.alias("_p"), F.xxhash64(*cols).alias("_h"))
        .groupBy(F.pmod("_h", F.lit(ranges)))
        .agg(F.min(F.struct("_h", "_p")).alias("_s"))
        .agg(F.sort_array(F.collect_list("_s._p")).alias("_l"))
    )
    last = F.floor((F.size("_l") - 1) / FENCE).cast("int")
    numbers = F.when(F.size("_l") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    fenced = sample.select(F.transform(numbers, lambda k: F.slice("_l", k * FENCE + 1, F.lit(FENCE))))

    def at(n: str) -> Column:
        return F.get(F.get("_borders", F.floor(F.col(n) / FENCE).cast("int")), F.pmod(F.col(n), F.lit(FENCE)))

    rows = df.withColumns({"_borders": fenced.scalar(), "_p": place})
    rows = rows.withColumn("_fences", F.size(F.filter("_borders", lambda g: g[0] <= F.col("_p"))))
    inside = F.size(F.filter(F.get("_borders", F.col("_fences") - 1), lambda b: b <= F.col("_p")))
    found = F.when(F.col("_fences") > 0, (F.col("_fences") - 1) * FENCE + inside).otherwise(0)
    # filters on the range stop at the generator; below it they would repeat the search
    rows = rows.select(*df.columns, "_borders", F.explode_outer(F.array(found)).alias("_n"))
    return rows.withColumns({"_m": F.col("_n") - 1}).select(
        *df.columns, F.col("_n").cast("long").alias(_B), F.when(F.col("_n") > 0, at("_m")).alias("_lower"), at("_n").alias("_upper")
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    start: int = 1,
    ranges: int = RANGES,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, range by range; ascending, nulls first.

    With no keys it numbers the whole table.  A group goes on in the next range only if a border lies in it, so there
    are no more such groups than borders: their counts, and nothing else, cross ranges.
    """
    columns = df.columns
    df = with_ranges(df, [*[F.col(k) for k in keys], *order], ranges)

    def in_group(border: str) -> Column:
        same = (F.col(border)[f"_{n}"].eqNullSafe(F.col(k)) for n, k in enumerate(keys))
        return reduce(and_, same, F.col(border).isNotNull())

    offsets = (
        df.where(in_group("_lower") | in_group("_upper"))
        .groupBy(*keys, _B)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_n", *(F.col(k).alias(f"_o{n}") for n, k in enumerate([*keys, _B])))
    )
    group = [f"_o{n}" for n in range(len(keys))]
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(f"_o{len(keys)}")
    offsets = offsets.withColumn("_offset", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_o{n}")) for n, k in enumerate([*keys, _B])))
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    # at most two rows per border
    return (
        df.join(F.broadcast(offsets), same, "left")
        .select(*columns, _B, F.coalesce("_offset", F.lit(0)).alias("_offset"))
        .withColumn(name, (F.row_number().over(inner) + F.col("_offset") + (start - 1)).cast("long"))
        .drop(_B, "_offset")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    how: str = "max",
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """Max or sum of ``value`` over all earlier rows of the group (null before the first)."""
    fn = {"max": F.max, "sum": F.sum}[how]
    df = df.withColumn(_B, int_bucket(order, width)).withColumn("_v", value)
    carried = (
        df.groupBy(*keys, _B)
        .agg(fn("_v").alias("_m"))
        .withColumn("_before", fn("_m").over(_preceding(keys)))
        .drop("_m")
    )
    inner = (
        Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    here = fn("_v").over(inner)
    both = (
        F.greatest(here, F.col("_before"))
        if how == "max"
        else F.coalesce(here + F.col("_before"), here, F.col("_before"))
    )
    return df.join(carried, [*keys, _B]).withColumn(name, both).drop(_B, "_v", "_before")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    reach: int,
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """Copy the rows within ``reach`` of a bucket border into the next bucket.

    The result has ``_bucket`` and ``_own``; a frame of at most ``reach`` rows
    over (keys, _bucket) ordered by ``pos`` is exact on rows with ``_own``.
    ``pos`` must be a dense rank starting at 1.
    """
    home = F.floor((F.col(pos) - 1) / width).cast("long")
    low = F.floor((F.col(pos) - 1 - reach) / width).cast("long")
    high = F.floor((F.col(pos) - 1 + reach) / width).cast("long")
    return (
        df.withColumn(_B, F.explode(F.array_distinct(F.array(home, low, high))))
        .withColumn("_own", F.col(_B) == home)
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """Exact median of ``value`` per group (nulls ignored), one row per group.

    Equal values are counted before the shuffle.  Sampled values cut the groups into ranges, counts find the range of
    the middle ranks, and only that range is sorted.
    """
    keys = list(keys)
    some = df.select(*keys, F.col(value).alias("_v")).dropna()
    counted = with_ranges(some, [F.col(c) for c in [*keys, "_v"]]).groupBy(*keys, _B, "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        counted.groupBy(*keys, _B)
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(upto))
        .withColumn("_all", F.sum("_bn").over(group))
        .withColumn("_lo", F.floor((F.col("_all") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_all") / 2) + 1)
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .where((F.col("_before") < F.col("_hi")) & (F.col("_upto") >= F.col("_lo")))
        .select(*keys, _B, "_before", "_lo", "_hi")
    )
    inner = Window.partitionBy(*keys, _B).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(middle, [*keys, _B])
        .withColumn("_last", F.sum("_n").over(inner) + F.col("_before"))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def at(rank: str) -> Column:
        hit = (F.col("_first") <= F.col(rank)) & (F.col("_last") >= F.col(rank))
        return F.max(F.when(hit, F.col("_v")))

    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(name))


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    text: str,
    sep: str,
    name: str = "text",
) -> DataFrame:
    """Join the texts of a group in order: first per bucket, then the few chunks."""
    part = (
        df.withColumn(_B, bucket)
        .groupBy(*keys, _B)
        .agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("_l"))
        .select(*keys, _B, F.array_join(F.transform("_l", lambda s: s["_t"]), sep).alias("_c"))
    )
    return (
        part.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(_B, "_c"))).alias("_l"))
        .select(*keys, F.array_join(F.transform("_l", lambda s: s["_c"]), sep).alias(name))
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the greatest by ``order``.

    An aggregate with map-side combine, so a hot group is reduced before it
    is shuffled.  Order columns must be non-null in the winning row.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_r")
    )
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
