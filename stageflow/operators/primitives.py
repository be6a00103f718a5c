"""Shared building blocks: ordered scans without one-task windows, dense grids, islands.

An ordered scan over a whole table (or over one dominant key) must not put all rows into a single window
partition.  ``running`` first collapses the rows to distinct order positions (a plain aggregate with
map-side combine, so a hot position costs nothing).  On a tick clock that leaves at most span / tick rows per key,
whatever the volume, and one window per key is fine (``levels=0``).  For finer clocks and continuous values the
positions are cut into buckets of at most ``width`` positions, and bucket totals are added up level by level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def total(df: DataFrame, **aggs: Column) -> Column:
    """Table-wide aggregates as one scalar sub-query; read the parts with ``.getField(name)``."""
    return df.agg(F.struct(*[expr.alias(name) for name, expr in aggs.items()]).alias("_t")).scalar()


def cut(code: Column, width: int) -> Column:
    """Bucket number of an integer; ``width`` is a power of two."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    return F.shiftright(code.cast("long"), width.bit_length() - 1)


def double_code(x: Column) -> Column:
    """Integer that never decreases with a double; cells are about 2e-10 wide relative to the value."""
    zero = F.lit(2**42)
    mag = F.floor(F.ln(F.abs(x)) * F.lit(float(2**32))).cast("long") + zero
    return F.when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0).cast("long"))


# Levels that bring the span of ``double_code`` down to at most a few hundred top buckets.
DOUBLE_LEVELS = 3


def _known(keys: Sequence[str], *codes: Column) -> Column:
    """All keys and bucket numbers present.

    The joins below imply these conditions.  Stating them on the input makes every copy of the aggregated
    input the same plan, so Spark shuffles it once and reuses the exchange.
    """
    ok = F.lit(True)
    for c in [*[F.col(k) for k in keys], *codes]:
        ok = ok & c.isNotNull()
    return ok


def _merge(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def _codes(code: Column, width: int, levels: int) -> list[Column]:
    out: list[Column] = []
    for _ in range(levels):
        out.append(cut(out[-1] if out else code, width))
    return out


def _spread(aggs, window, offset=None) -> list[Column]:
    """The value at a position, up to it and before it, optionally on top of a bucket offset."""
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name, (kind, _) in aggs.items():
        for frame, tag in ((upto, "cum"), (before, "before")):
            value = _COMBINE[kind](name).over(frame)
            if offset is not None:
                value = _merge(kind, offset(name), value)
            elif kind == "sum":
                value = F.coalesce(value, F.lit(0))
            out.append(value.alias(f"{tag}_{name}"))
        out.append(F.col(name))
    return out


def running(
    df: DataFrame,
    order: str,
    aggs: Mapping[str, tuple[str, Column | str]],
    keys: Sequence[str] = (),
    code: Column | None = None,
    width: int = WIDTH,
    levels: int = 0,
) -> DataFrame:
    """Running aggregates in ``order``, one output row per distinct (keys, order).

    ``aggs`` maps a name to (``sum`` | ``max`` | ``min``, expression).  The result has ``<name>`` (this position),
    ``cum_<name>`` (up to and including it) and ``before_<name>`` (strictly before it; null if nothing
    precedes and the aggregate is not a sum).  ``code`` is an integer that grows with ``order``; it defaults to
    ``order`` itself.  With L levels the topmost windows see span / width**L positions: keep that below a million.
    """
    keys = list(keys)
    col = code if code is not None else F.col(order)
    bucket = f"_bucket{levels}"
    codes = _codes(col, width, levels)
    at = df.where(_known([*keys, order], *codes)).groupBy(*keys, order).agg(
        *[_COMBINE[kind](expr).alias(name) for name, (kind, expr) in aggs.items()]
    )
    if levels == 0:
        return at.select(*keys, order, *_spread(aggs, Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)))
    at = at.withColumn(bucket, codes[0])
    totals = at.groupBy(*keys, bucket).agg(
        *[_COMBINE[kind](name).alias(name) for name, (kind, _) in aggs.items()]
    )
    if levels > 1:
        offsets = running(
            totals, bucket, {n: (k, F.col(n)) for n, (k, _) in aggs.items()}, keys, None, width, levels - 1
        ).select(*keys, bucket, *[F.col(f"before_{n}").alias(f"_off_{n}") for n in aggs])
    else:
        top = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *keys, bucket, *[_COMBINE[k](n).over(top).alias(f"_off_{n}") for n, (k, _) in aggs.items()]
        )
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    return at.join(offsets, [*keys, bucket]).select(*keys, order, *_spread(aggs, inside, lambda n: F.col(f"_off_{n}")))


def running_rows(
    df: DataFrame,
    order: str,
    tie: str,
    sums: Mapping[str, Column | str],
    keys: Sequence[str] = (),
    width: int = WIDTH,
    levels: int = 0,
    tie_width: int = 2**20,
    then: Sequence[str] = (),
) -> DataFrame:
    """Row-level running sums in the total order (``order``, ``tie``); adds ``cum_<name>`` to every row.

    (keys, order, tie) must be unique and not null, or the columns ``then`` order the rows that share it.  A hot order value is cut into grains of ``tie_width`` tie values, so
    neither the join nor the last window ever holds more than ``tie_width`` rows in one group.
    """
    keys = list(keys)
    codes = _codes(F.col(order), width, levels)
    grain = cut(F.col(tie), tie_width)
    rows = df.where(_known([*keys, order], grain, *codes)).withColumn("_grain", grain)
    for name, expr in sums.items():
        rows = rows.withColumn(f"_v_{name}", expr if isinstance(expr, Column) else F.col(expr))
    grains = rows.groupBy(*keys, order, "_grain").agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    ticks = running(grains, order, {n: ("sum", F.col(n)) for n in sums}, keys, None, width, levels).select(
        *keys, order, *[F.col(f"before_{n}").alias(f"_tick_{n}") for n in sums]
    )
    in_tick = Window.partitionBy(*keys, order).orderBy("_grain").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grains.join(ticks, [*keys, order]).select(
        *keys,
        order,
        "_grain",
        *[(F.col(f"_tick_{n}") + F.coalesce(F.sum(n).over(in_tick), F.lit(0))).alias(f"_off_{n}") for n in sums],
    )
    in_grain = Window.partitionBy(*keys, order, "_grain").orderBy(tie, *then).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*keys, order, "_grain"])
    for n in sums:
        joined = joined.withColumn(f"cum_{n}", F.col(f"_off_{n}") + F.sum(f"_v_{n}").over(in_grain))
    return joined.drop("_grain", *[f"_v_{n}" for n in sums], *[f"_off_{n}" for n in sums])


def ranked(
    df: DataFrame, order: str, tie: str, keys: Sequence[str] = (), name: str = "rank", **kw
) -> DataFrame:
    """Dense 1-based row number per key in (``order``, ``tie``) order, without a one-task window."""
    return running_rows(df, order, tie, {name: F.lit(1)}, keys, **kw).withColumnRenamed(f"cum_{name}", name)


def trailing(
    df: DataFrame, rank: str, length: int, columns: Mapping[str, object], keys: Sequence[str] = (), block: int = 8192
) -> DataFrame:
    """Aggregates over the last ``length`` rows of a dense rank, per key.

    Ranks are cut into blocks of equal size; the last ``length - 1`` rows of a block are copied to the next
    one, so each block is complete on its own and one dominant key still spreads over many tasks.
    ``columns`` maps an output name to a function that takes the window and returns a Column.
    """
    block = max(block, length)
    own = F.floor((F.col(rank) - 1) / F.lit(block)).cast("long")
    spills = (F.col(rank) - 1) % block >= block - (length - 1)
    spread = df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(spills, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(-(length - 1), 0)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(frame))
    return spread.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def cumulative_at(
    events: DataFrame, order: str, sums: Mapping[str, Column | str], probes: DataFrame, keys: Sequence[str] = (), **kw
) -> DataFrame:
    """Running sums of ``events`` read at the ``order`` values of ``probes`` (as-of, closed on the right).

    ``probes`` holds the columns keys + [order].  Returns one row per distinct probe with ``cum_<name>``.
    """
    keys = list(keys)
    left = events.select(
        *keys, F.col(order), F.lit(0).alias("_probe"),
        *[(e if isinstance(e, Column) else F.col(e)).alias(n) for n, e in sums.items()],
    )
    right = probes.select(*keys, order).distinct().select(
        *keys, F.col(order), F.lit(1).alias("_probe"), *[F.lit(0).alias(n) for n in sums]
    )
    scan = running(
        left.unionByName(right), order,
        {"_probe": ("max", F.col("_probe")), **{n: ("sum", F.col(n)) for n in sums}}, keys, **kw,
    )
    return scan.where(F.col("_probe") == 1).select(*keys, order, *[f"cum_{n}" for n in sums])


def previous_position(df: DataFrame, order: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Distinct order positions with row count ``n`` and the preceding distinct position ``prev``."""
    return running(
        df, order, {"n": ("sum", F.lit(1)), "p": ("max", F.col(order))}, keys, **kw
    ).select(*keys, order, "n", F.col("before_p").alias("prev"))


def dense_grid(bounds: DataFrame, start: str, stop: str, step: Column | int, name: str = "slot") -> DataFrame:
    """One row per grid point of every row's closed range [start, stop]."""
    step = step if isinstance(step, Column) else F.lit(step)
    return bounds.withColumn(name, F.explode(F.sequence(F.col(start), F.col(stop), step.cast("long"))))


def islands(df: DataFrame, position: str, keys: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Label runs of consecutive integer positions; rows must be unique per (keys, position)."""
    rank = running(df, position, {"k": ("sum", F.lit(1))}, keys).select(*keys, position, "cum_k")
    return df.join(rank, [*keys, position]).withColumn(name, F.col(position) - F.col("cum_k")).drop("cum_k")


def quantiles(
    df: DataFrame, value: str, points: Sequence[float], keys: Sequence[str] = (), code: Column | None = None,
    levels: int = DOUBLE_LEVELS,
) -> DataFrame:
    """Exact linear-interpolation quantiles by rank selection: one row per (keys, point).

    Unlike an aggregate that buffers every distinct value of a group in one task, this only orders values
    bucket by bucket.  Null values are ignored.
    """
    keys = list(keys)
    counts = running(df, value, {"n": ("sum", F.lit(1))}, keys, code if code is not None else double_code(F.col(value)), levels=levels)
    totals = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    placed = counts.join(totals, keys) if keys else counts.withColumn("_total", total(df, n=F.count(value)).getField("n"))
    return select_quantiles(placed, value, points, keys)


def select_quantiles(placed: DataFrame, value: str, points: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles from distinct values with ``before_n`` and ``cum_n`` in ascending order and ``_total`` rows."""
    at = lambda q: (F.col("_total") - 1) * q
    inside = lambda pos: (pos >= F.col("before_n")) & (pos < F.col("cum_n"))
    hit = placed.withColumn(
        "_q",
        F.explode(F.filter(F.array(*[F.lit(float(q)) for q in points]), lambda q: inside(F.floor(at(q))) | inside(F.ceil(at(q))))),
    )
    q, v = F.col("_q"), F.col(value).cast("double")
    low = F.max(F.when(inside(F.floor(at(q))), v))
    high = F.max(F.when(inside(F.ceil(at(q))), v))
    frac = F.max(at(q) - F.floor(at(q)))
    return hit.groupBy(*keys, q.alias("point")).agg((low + (high - low) * frac).alias("quantile"))
