"""Sliding-window scans for failure surges and measurement drift, with false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions import stats as ST
from stageflow.operators import joins as J
from stageflow.operators import primitives as P
from stageflow.session import dictionary, materialize


def adjust_p(candidates: DataFrame, p: str = "raw_p", name: str = "adj_p") -> DataFrame:
    """STAT2: Benjamini-Hochberg adjustment over all rows.

    The candidates are collapsed to distinct p-values and scanned in buckets.  For equal p-values only the largest rank matters,
    because the running minimum comes from above.
    """
    kept = materialize(candidates, "candidates")
    n = F.lit(kept.count())
    ranks = P.running(kept, p, {"k": ("sum", F.lit(1))}, code=P.double_code(F.col(p)), levels=P.DOUBLE_LEVELS)
    scaled = materialize(ranks.select(p, (F.col(p) * n / F.col("cum_k")).alias("_q"), (-F.col(p)).alias("_neg")), "adjusted")
    best = P.running(scaled, "_neg", {"q": ("min", F.col("_q"))}, code=P.double_code(F.col("_neg")), levels=P.DOUBLE_LEVELS).select(
        (-F.col("_neg")).alias(p), F.least(F.lit(1.0), F.col("cum_q")).alias(name)
    )
    return kept.join(best, p)


def surge_scan(
    visits: DataFrame, windows: Sequence[tuple[str, int]], step: int, min_n: int, min_defects: int, min_ratio: float,
    min_rows: int = 0, stage: str = "stage", t: str = "entry", label: str = "label",
) -> DataFrame:
    """STAT4: windows whose failure rate stands out against the stage's own rate, with adjusted p-values."""
    ticks = visits.groupBy(stage, t).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("d"))
    stages = (
        ticks.groupBy(stage)
        .agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.sum("n").alias("_n"), F.sum("d").alias("_d"))
        .where(F.col("_n") >= min_rows)
    )
    base = stages.select(stage, (F.col("_d") / F.col("_n")).alias("baseline_rate"))
    grid = J.sliding_grid(
        ticks, stages.drop("_n", "_d"), (stage,), t, windows, step, {"n": F.sum("n"), "defects": F.sum("d")}
    )
    rate = F.col("defects") / F.col("n")
    hits = (
        grid.where((F.col("n") >= min_n) & (F.col("defects") >= min_defects))
        .join(base, stage)
        .withColumn("observed_rate", rate)
        .withColumn("ratio", S.ratio(rate, F.col("baseline_rate"), 0.0))
        .where(F.col("ratio") >= min_ratio)
        .withColumn("raw_p", ST.binomial_upper_p(F.col("defects"), F.col("n"), F.col("baseline_rate")))
    )
    return adjust_p(hits)


def drift_scan(
    values: DataFrame, windows: Sequence[tuple[str, int]], step: int, min_n: int, min_z: float, min_rows: int = 200,
    stage: str = "stage", feature: str = "feature", t: str = "entry", value: str = "value",
) -> DataFrame:
    """STAT5: windows whose mean reading is far from the feature's own mean, with adjusted p-values."""
    keys = (stage, feature)
    moments = (
        values.groupBy(*keys)
        .agg(
            F.count(value).alias("_rows"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"),
            F.min(t).alias("t_min"), F.max(t).alias("t_max"),
        )
        .where((F.col("_rows") >= min_rows) & (F.col("sigma") > 0))
    )
    ticks = values.groupBy(*keys, t).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    grid = J.sliding_grid(
        ticks, moments.select(*keys, "t_min", "t_max"), keys, t, windows, step, {"n": F.sum("n"), "s": F.sum("s")}
    )
    mean = F.col("s") / F.col("n")
    hits = (
        grid.where(F.col("n") >= min_n)
        .join(moments.select(*keys, "mu", "sigma"), list(keys))
        .withColumn("observed_mean", mean)
        .withColumn("z", (mean - F.col("mu")) / F.col("sigma"))
        .where(F.abs("z") >= min_z)
        .withColumn("raw_p", ST.mean_shift_p(F.col("observed_mean"), F.col("mu"), F.col("sigma"), F.col("n")))
        .drop("s")
    )
    return adjust_p(hits)


def separate_windows(
    candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], gap: int, top: int | None = None,
    start: str = "t_start",
) -> DataFrame:
    """SRT4: greedy choice in ``order``; a window is skipped if a chosen one of its key starts within ``gap``.

    With ``top``, the best remaining row is taken ``top`` times and its neighbours are left out; only chosen rows reach the driver.
    Without it, rounds choose every row that comes before all undecided rows of the slots around it, which the greedy choice must take too,
    and leave out the rows near a chosen one, until none is undecided.  Equal rows are told apart by a row number.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = materialize(candidates.select("*", *[expr.alias(n) for n, expr in zip(names, order)], F.monotonically_increasing_id().alias("_row")), "scored")
    place = [*names, "_row"]
    if top is not None:
        chosen: list = []
        free = F.lit(True)
        for _ in range(top):
            best = rows.where(free).orderBy(*place).limit(1).collect()
            if not best:
                break
            chosen += best
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.lit(best[0][k]))
            free = free & ~(same & (F.abs(F.col(start) - best[0][start]) < gap))
        return rows.sparkSession.createDataFrame(chosen, rows.schema).select(*candidates.columns)
    slot = F.floor(F.col(start) / gap).cast("long")
    near = F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)).alias("_slot")
    left, done = rows.withColumn("_slot", slot), None
    while left.limit(1).count():
        best = left.groupBy(*keys, "_slot").agg(F.min(F.struct(*place)).alias("_best"))
        around = best.select(*keys, near, "_best").groupBy(*keys, "_slot").agg(F.min("_best").alias("_best"))
        picked = materialize(left.join(around, [*keys, "_slot"]).where(F.struct(*place) == F.col("_best")).drop("_best"), "picked")
        done = picked if done is None else done.unionByName(picked)
        taken = picked.select(*keys, near, F.col(start).alias("_at"))
        left = materialize(left.join(taken, [*keys, "_slot"], "left_anti").unionByName(
            left.join(taken.groupBy(*keys, "_slot").agg(F.collect_list("_at").alias("_at")), [*keys, "_slot"])
            .where(~F.exists("_at", lambda x: F.abs(F.col(start) - x) < gap)).drop("_at")), "undecided")
    return (rows if done is None else done).select(*candidates.columns)


def master_ranking(surges: DataFrame, drifts: DataFrame) -> DataFrame:
    """SRT5: surges first, then drifts, each in its own order, with a running rank (short final lists only)."""
    s = surges.select(
        F.lit(0).alias("_kind"), F.lit("Defect Rate Surge").alias("anomaly_type"), "stage", F.lit("label").alias("feature"),
        "t_start", "t_end", "n", F.col("defects").cast("long").alias("failures"), F.col("observed_rate").alias("observed"), F.col("baseline_rate").alias("baseline"), F.col("ratio").alias("effect"), "adj_p",
    )
    d = drifts.select(
        F.lit(1).alias("_kind"), F.lit("Measurement Drift").alias("anomaly_type"), "stage", "feature",
        "t_start", "t_end", "n", F.lit(None).cast("long").alias("failures"), F.col("observed_mean").alias("observed"), F.col("mu").alias("baseline"), F.col("z").alias("effect"), "adj_p",
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_kind", F.round("adj_p", 8), F.desc(F.round(F.abs("effect"), 6)), "t_start", "stage", "feature")
    return s.unionByName(d).withColumn("rank", F.row_number().over(w)).drop("_kind")


def evaluate_windows(
    visits: DataFrame, windows: DataFrame, base: Column, stage: str = "stage", t: str = "entry", entity: str = "entity",
    label: str = "label",
) -> DataFrame:
    """AGG35: distinct entities and failures per named window and stage list, against the expectation.

    ``windows``: event_id, t_start, t_end, stages (array); it is configuration, so one row per (window, stage)
    is matched by an equi-join on the stage.
    """
    flat = windows.select("event_id", "t_start", "t_end", F.explode("stages").alias(stage))
    hit = visits.join(dictionary(flat, "windows"), stage).where(S.in_interval(F.col(t), F.col("t_start"), F.col("t_end")))
    per = hit.groupBy("event_id", "t_start", "t_end", entity).agg(F.max(label).alias("_y"))
    out = per.groupBy("event_id", "t_start", "t_end").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("_y").cast("long").alias("failures")
    )
    expected = F.col("entities") * base
    z = ST.binomial_z(F.col("failures"), F.col("entities"), base)
    return out.select(
        "event_id", "t_start", "t_end", "entities", "failures",
        expected.alias("expected"),
        (F.col("failures") - expected).alias("excess"),
        (F.col("failures") / F.greatest(F.lit(1e-6), expected)).alias("oe_ratio"),
        (F.col("failures") * 100.0 / F.col("entities")).alias("rate_pct"),
        ST.upper_tail(z).alias("p_value"),
    )


def failure_overlap(
    visits: DataFrame, windows: DataFrame, stage: str = "stage", t: str = "entry", entity: str = "entity", label: str = "label"
) -> DataFrame:
    """AGG36: failed entities seen at all stages of a window and at any of them, counted per entity, not by sets."""
    flat = windows.select("event_id", "t_start", "t_end", F.size("stages").alias("_need"), F.explode("stages").alias(stage))
    hit = visits.where(F.col(label) == 1).join(dictionary(flat, "windows"), stage).where(S.in_interval(F.col(t), F.col("t_start"), F.col("t_end"), "left"))
    per = hit.groupBy("event_id", "_need", entity).agg(F.count_distinct(stage).alias("_s"))
    return per.groupBy("event_id").agg(
        F.count_if(F.col("_s") == F.col("_need")).alias("at_all"), F.count(F.lit(1)).alias("at_any")
    ).withColumn("shared_pct", F.col("at_all") * 100.0 / F.col("at_any"))


def slowdown(visits: DataFrame, windows: DataFrame, minutes: float, stage: str = "stage", t: str = "entry") -> DataFrame:
    """AGG37: is a slow window a general slowdown or the work of one or two extreme dwell times?

    Durations are counted before they are ranked, so the two largest values come from the counts.
    """
    dur = F.col("duration") * minutes
    p = F.percentile("duration", F.array(F.lit(0.5), F.lit(0.99)), F.col("_n"))
    base = (
        visits.groupBy(stage, "duration").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(stage).agg((p.getItem(0) * minutes).alias("base_p50"), (p.getItem(1) * minutes).alias("base_p99"))
    )
    hit = visits.join(dictionary(windows, "windows"), stage).where(S.in_interval(F.col(t), F.col("t_start"), F.col("t_end"), "left"))
    counted = hit.groupBy("window", stage, dur.alias("_d")).agg(F.count(F.lit(1)).alias("_n")).join(base, stage)
    above = F.col("_d") > F.col("base_p99")
    largest = F.max(F.struct("_d", "_n"))
    next_d = F.max_by("_d", F.col("_d"))
    out = counted.groupBy("window", stage).agg(
        F.max("base_p50").alias("base_p50"), F.max("base_p99").alias("base_p99"),
        F.sum("_n").alias("n"),
        (F.sum(F.col("_d") * F.col("_n"))).alias("_sum"),
        F.percentile("_d", F.lit(0.5), F.col("_n")).alias("median"),
        F.sum(F.when(above, F.col("_n")).otherwise(0)).alias("n_above"),
        largest.alias("_top"), next_d.alias("_top_d"),
    )
    second = (
        counted.join(out.select("window", stage, "_top_d"), ["window", stage])
        .where(F.col("_d") < F.col("_top_d")).groupBy("window", stage).agg(F.max("_d").alias("_second"))
    )
    top1 = F.col("_top._d")
    return out.join(second, ["window", stage], "left").select(
        "window", stage, "n", (F.col("_sum") / F.col("n")).alias("mean"), "median", "base_p50", "base_p99", "n_above",
        (F.col("n_above") * 100.0 / F.col("n")).alias("above_pct"),
        top1.alias("top1"),
        F.when(F.col("_top._n") > 1, top1).otherwise(F.coalesce("_second", F.lit(0.0))).alias("top2"),
        "_sum",
    ).select(
        "*",
        F.when(F.col("n") > 2, (F.col("_sum") - F.col("top1") - F.col("top2")) / (F.col("n") - 2)).otherwise(0.0).alias("mean_without_top2"),
        ((F.col("n_above") <= 4) & (F.col("top1") > F.col("base_p99") * 5.0)).alias("outlier_driven"),
    ).drop("_sum")


def binned_timeline(
    visits: DataFrame, values: DataFrame, width: int, stage: str = "stage", t: str = "entry", label: str = "label", feature: str = "feature"
) -> DataFrame:
    """AGG38: count, failures, rate and mean reading per stage, feature and bin; empty bins stay null, never interpolated."""
    slot = F.floor(F.col(t) / F.lit(width)).cast("long")
    rates = visits.groupBy(stage, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("defects"))
    means = values.groupBy(stage, feature, slot.alias("bin")).agg(F.avg("value").alias("mean_value"))
    span = rates.groupBy(stage).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    # One row a stage, bin and feature that the stage has.
    features = means.groupBy(stage).agg(F.collect_set(feature).alias("_features"))
    grid = P.dense_grid(span.join(features, stage), "_a", "_b", 1, "bin").select(stage, "bin", F.explode("_features").alias(feature))
    return grid.join(rates, [stage, "bin"], "left").join(means, [stage, feature, "bin"], "left").select(
        stage, feature, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("defects", F.lit(0)).alias("defects"),
        (F.col("defects") / F.col("n")).alias("rate"), "mean_value",
    )


def autocorrelation(events: DataFrame, t: str, width: int, lags: Sequence[int]) -> DataFrame:
    """STAT3: autocorrelation of the event histogram over a lag range, on dense bins (empty bins count 0).

    The dense histogram has span / width rows; each bin is paired only with its own lagged bins.
    """
    hist = events.groupBy(F.floor(F.col(t) / F.lit(width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    span = hist.agg(F.min("bin").alias("_a"), F.max("bin").alias("_b"))
    dense = P.dense_grid(span, "_a", "_b", 1, "bin").select("bin").join(hist, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = P.total(dense, m=F.avg("n")).getField("m")
    x = dense.select("bin", (F.col("n") - mean).alias("x"))
    power = P.total(x, p=F.sum(F.col("x") * F.col("x"))).getField("p")
    shifted = x.select(F.explode(F.array(*[F.lit(int(k)) for k in lags])).alias("lag"), "bin", F.col("x").alias("y")).withColumn(
        "bin", F.col("bin") + F.col("lag")
    )
    return (
        x.join(shifted, "bin")
        .groupBy("lag")
        .agg(F.sum(F.col("x") * F.col("y")).alias("_s"))
        .select("lag", (F.col("_s") / power).alias("acf"))
    )


def production_gaps(events: DataFrame, t: str, threshold: int, keys: Sequence[str] = (), **kw) -> DataFrame:
    """STAT6: stretches between consecutive event times longer than ``threshold``."""
    pos = P.previous_position(events, t, keys, **kw)
    return pos.where(F.col(t) - F.col("prev") > threshold).select(
        *keys, F.col("prev").alias("gap_start"), F.col(t).alias("gap_end"), (F.col(t) - F.col("prev")).alias("gap")
    )
