"""Stage health, entity risk and line overview, computed over a whole message table.

Messages are ordered by (t, stage rank, entity).  Rolling counts per stage and running line totals are ordered
scans over dominant keys, so they use the bucketed primitives instead of one window per stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.scalar import ScoreConfig
from stageflow.operators import primitives as P
from stageflow.session import dictionary, materialize

CFG = ScoreConfig()


def message_tie(rank: str = "stage_rank", entity: str = "entity") -> Column:
    """Integer that orders messages of the same time by (stage rank, entity); entities are below 2**48."""
    return F.shiftleft(F.col(rank).cast("long"), 48) + F.col(entity)


def baseline_maps(baselines: DataFrame, stage: str = "stage", feature: str = "feature") -> DataFrame:
    """One map feature -> (mean, std) per stage; its size is the number of sensor columns."""
    entry = F.struct(F.col(feature), F.struct("mean", "std"))
    return baselines.groupBy(stage).agg(F.map_from_entries(F.collect_list(entry)).alias("_base"))


def deviations(messages: DataFrame, baselines: DataFrame, cfg: ScoreConfig = CFG, stage: str = "stage", sensors: Sequence[str] = ()) -> DataFrame:
    """STR8: z-scores of every reading of a message; unknown features count as 0.  Works on streams and tables.

    ``sensors`` names the columns that hold the readings too, where ``features`` is the map of all that aren't null: they are scored as columns, which
    compiles, while a function over the map's entries is interpreted for every row.
    """
    if sensors:
        return _column_deviations(messages, baselines, cfg, stage, sensors)
    joined = messages.join(dictionary(baseline_maps(baselines, stage), "baselines"), stage, "left")

    def score(e: Column) -> Column:
        known = F.try_element_at(F.col("_base"), e["key"])
        return F.struct(e["key"].alias("feature"), S.z_score(e["value"], known["mean"], known["std"]).alias("z"))

    zs = F.transform(F.map_entries("features"), score)
    return (
        joined.withColumn("zs", zs)
        .drop("_base")
        .withColumn("n_features", F.coalesce(F.size("features"), F.lit(0)))
        .withColumn("max_abs_z", F.coalesce(F.array_max(F.transform("zs", lambda x: F.abs(x["z"]))), F.lit(0.0)))
        .withColumn("anomalous", F.filter("zs", lambda x: F.abs(x["z"]) >= cfg.z_threshold))
    )


def _column_deviations(messages: DataFrame, baselines: DataFrame, cfg: ScoreConfig, stage: str, sensors: Sequence[str]) -> DataFrame:
    """``deviations`` of readings in columns; only rows with an anomalous reading are searched for it."""
    base = baseline_maps(baselines, stage).select(stage, *[F.try_element_at("_base", F.lit(s)).alias(f"_base_{s}") for s in sensors])
    z = {s: S.z_score(F.col(s), F.col(f"_base_{s}.mean"), F.col(f"_base_{s}.std")) for s in sensors}
    scored = messages.join(dictionary(base, "baselines"), stage, "left").withColumns({f"_z_{s}": F.when(F.col(s).isNotNull(), e) for s, e in z.items()})
    pairs = F.array(*[F.struct(F.lit(s).alias("feature"), F.col(f"_z_{s}").alias("z")) for s in sensors])
    none = F.array().cast("array<struct<feature:string,z:double>>")
    return scored.withColumns({
        "zs": F.filter(pairs, lambda x: x["z"].isNotNull()),
        "n_features": sum((F.col(s).isNotNull().cast("int") for s in sensors), F.lit(0)),
        "max_abs_z": F.coalesce(F.array_max(F.array(*[F.abs(F.col(f"_z_{s}")) for s in sensors])), F.lit(0.0)),
    }).withColumn(
        "anomalous", F.when(F.col("max_abs_z") >= cfg.z_threshold, F.filter(pairs, lambda x: F.abs(x["z"]) >= cfg.z_threshold)).otherwise(none)
    ).drop(*[f"_base_{s}" for s in sensors], *[f"_z_{s}" for s in sensors])


def lives(messages: DataFrame) -> DataFrame:
    """Arrival order inside an entity: state restarts after an exit message, as the live scorer forgets the entity.

    An entity sends at most one message per stage and life, so these windows are small. A life ends with its exit message, so it has one at most:
    ``nth`` is the message's number in its life; ``exit_t``, ``exit_tie`` and ``exit_label`` say on every message of the life when it comes and what outcome it reveals.
    """
    order = Window.partitionBy("entity").orderBy("t", "stage_rank", "stage")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    with_life = messages.withColumn("life", F.coalesce(F.sum(F.col("is_exit").cast("int")).over(before), F.lit(0)))
    state = Window.partitionBy("entity", "life").orderBy("t", "stage_rank", "stage")
    whole = state.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaves = F.struct("t", message_tie().alias("tie"), F.coalesce("response", F.lit(0)).alias("label"))
    out = with_life.withColumns({
        "arrived_from": F.lag("stage").over(state), "nth": F.row_number().over(state), "_exit": F.max(F.when(F.col("is_exit"), leaves)).over(whole)
    })
    return out.select("*", (F.col("nth") == 1).alias("is_first"), *[F.col(f"_exit.{c}").alias(f"exit_{c}") for c in ("t", "tie", "label")]).drop("_exit")


def rolling_drift(scored: DataFrame, window: int = CFG.window) -> DataFrame:
    """WIN4 (and the visit number WIN5 needs): mean of the last ``window`` largest deviations of the stage."""
    ranked = P.ranked(scored, "t", "entity", ("stage",), "visit_no", then=[c for c in ("life", "nth") if c in scored.columns])
    return P.trailing(ranked, "visit_no", window, {"avg_z": lambda w: F.avg("max_abs_z").over(w)}, ("stage",)).withColumn(
        "window_parts", F.least(F.col("visit_no"), F.lit(window))
    )


def rolling_p90(visits: DataFrame, window: int = CFG.window) -> DataFrame:
    """WIN6: 90th percentile of the last ``window`` transits of the stage."""
    ranked = P.ranked(visits, "t", "entity", ("stage",), "visit_no")
    return P.trailing(
        ranked, "visit_no", window, {"p90_transit": lambda w: F.percentile("transit_minutes", F.lit(0.9)).over(w)}, ("stage",)
    )


def rolling_outcomes(
    visits: DataFrame, window: int = CFG.window, default: float = CFG.base_rate, carry: Sequence[str] = ()
) -> DataFrame:
    """WIN5: mean of the last ``window`` outcomes a stage had learnt before each visit, else the base rate.

    An outcome reaches a stage when the entity's exit message arrives, provided the entity visited the stage in
    that life and is still among the stage's last ``window`` visits.  ``visits``: entity, stage, life, t, tie, visit_no, with the
    exit of the life as ``lives`` adds it; the columns ``carry`` are passed on.  Positions double the tie so that a visit
    precedes the outcome carried by the same message.

    The first scan, which finds the outcomes that count, takes none of the visits' other columns. Each of these outcomes then
    changes the sum of the last ``window`` ones by its label less that of the one it displaces, so the second scan, over the
    visits and these changes, reads the sum itself.
    """
    pos = (F.col("tie") * 2).alias("_pos")
    seen = visits.select("stage", "t", pos, F.lit(1).alias("_visit"), F.lit(None).cast("long").alias("visit_no"), F.lit(None).cast("int").alias("label"))
    learnt = visits.where(F.col("exit_t").isNotNull() & (F.struct("t", "tie") <= F.struct("exit_t", "exit_tie"))).select(
        "stage", F.col("exit_t").alias("t"), (F.col("exit_tie") * 2 + 1).alias("_pos"), F.lit(0).alias("_visit"), "visit_no", F.col("exit_label").alias("label")
    )
    counted = P.running_rows(seen.unionByName(learnt), "t", "_pos", {"seen": F.col("_visit")}, ("stage",))
    in_window = F.col("cum_seen") - F.col("visit_no") < window
    kept = materialize(counted.where((F.col("_visit") == 0) & in_window).select("stage", "t", "_pos", "label"), "outcomes")
    numbered = P.trailing(
        P.ranked(kept, "t", "_pos", ("stage",), "_k"), "_k", window + 1, {"_first": lambda w: F.first("label").over(w.rowsBetween(-window, -window))}, ("stage",)
    )
    left = F.when(F.col("_k") > window, F.col("_first")).otherwise(F.lit(0))
    changes = materialize(numbered.select("stage", "t", "_pos", F.lit(1).alias("_o"), (F.col("label") - left).alias("_c")), "changes")
    rows = visits.select("stage", "entity", "life", "t", pos, *carry, F.lit(0).alias("_o"), F.lit(0).alias("_c")).unionByName(changes, allowMissingColumns=True)
    scan = P.running_rows(rows, "t", "_pos", {"k": F.col("_o"), "c": F.col("_c")}, ("stage",)).where("_o = 0")
    rate = F.col("cum_c") / F.least(F.col("cum_k"), F.lit(window))
    return scan.select("stage", "entity", "life", *carry, F.when(F.col("cum_k") > 0, rate).otherwise(F.lit(default)).alias("observed_rate"))


def stage_health(
    messages: DataFrame, baselines: DataFrame, benchmark: DataFrame, topology: DataFrame, cfg: ScoreConfig = CFG, sensors: Sequence[str] = ()
) -> DataFrame:
    """SCO1: composite health of the stage at every visit, with its three sub-scores.

    ``messages`` may carry their ``lives`` already, and their readings as the columns ``sensors``.  The ordered scans only take the columns they need; the others meet
    the scans' results in one join at the end.
    """
    lived = messages if "life" in messages.columns else materialize(lives(messages), "lives")
    scored = deviations(lived, baselines, cfg, sensors=sensors).withColumn("tie", message_tie()).drop("features", "zs", "prev_stage", *sensors)
    exits = ["exit_t", "exit_tie", "exit_label"]
    drift = rolling_drift(scored.select("stage", "entity", "life", "nth", "t", "tie", "max_abs_z", *exits), cfg.window)
    numbered = materialize(drift.drop("max_abs_z", "window_parts"), "numbered")
    outcomes = rolling_outcomes(numbered, cfg.window, cfg.base_rate, ("nth", "visit_no", "avg_z"))
    # a message that comes twice keeps its own drift and takes the rate of each: both sides of the join need this order anyway
    peers = F.collect_list(F.struct("nth", "visit_no", "avg_z")).over(Window.partitionBy("stage", "entity", "life"))
    outcomes = outcomes.withColumn("_peers", peers).drop("nth", "visit_no", "avg_z")
    paced = (
        scored.drop(*exits).join(dictionary(topology, "topology"), "stage", "left")
        .withColumn("incoming", F.coalesce("arrived_from", "static_prev"))
        .join(dictionary(benchmark.select(F.col("prev_stage").alias("incoming"), "stage", "p90", "p99"), "benchmark"), ["incoming", "stage"], "left")
        .withColumn("p90", F.coalesce("p90", F.lit(cfg.default_p90)))
        .withColumn("p99", F.coalesce("p99", F.lit(cfg.default_p99)))
        .join(outcomes, ["stage", "entity", "life"])
        .withColumn("_own", F.when(F.size("_peers") == 1, F.col("_peers")[0]).otherwise(F.filter("_peers", lambda p: p["nth"] == F.col("nth"))[0]))
        .withColumns({"visit_no": F.col("_own.visit_no"), "avg_z": F.col("_own.avg_z")})
        .drop("_own", "_peers", "nth")
        .withColumn("window_parts", F.least(F.col("visit_no"), F.lit(cfg.window)))
    )
    drift = S.drift_score(F.col("avg_z"), F.col("n_features"))
    pacing = S.pacing_score(F.col("transit_minutes"), F.col("p90"), F.col("p99"), F.col("incoming").isNotNull())
    defect = S.defect_score(F.col("observed_rate"), F.lit(cfg.base_rate))
    return (
        paced.withColumn("health_score", S.composite_health(drift, pacing, defect, cfg))
        .withColumn("feature_drift_score", F.round(drift, 2))
        .withColumn("transit_pacing_score", F.round(pacing, 2))
        .withColumn("defect_rate_score", F.round(defect, 2))
        .withColumn("status", S.health_status(F.col("health_score"), cfg))
        .withColumn("observed_defect_rate", F.round(F.col("observed_rate") * 100.0, 4))
        .withColumn("anomalous_features", F.transform("anomalous", lambda x: x["feature"]))
        .drop("static_prev", "p90", "p99", "avg_z", "observed_rate")
    )


def entity_history(scored: DataFrame) -> DataFrame:
    """WIN10: cumulative anomalies, stages visited and the last five deviations of the entity's current life."""
    state = Window.partitionBy("entity", "life").orderBy("t", "stage_rank", "stage").rowsBetween(Window.unboundedPreceding, 0)
    tagged = F.transform(
        "anomalous", lambda x: F.struct(F.col("stage").alias("stage"), x["feature"].alias("feature"), F.round(x["z"], 2).alias("z_score"))
    )
    out = (
        scored.withColumn("_dev", tagged)
        .withColumn("cumulative_anomalies", F.sum(F.size("anomalous")).over(state))
        .withColumn("stages_visited", F.collect_list("stage").over(state))
        .withColumn("_all", F.flatten(F.collect_list("_dev").over(state)))
    )
    n = F.size("_all")
    return out.withColumn("top_deviations", F.slice("_all", F.greatest(n - 4, F.lit(1)), F.lit(5))).drop("_dev", "_all")


def part_risk(health: DataFrame, cfg: ScoreConfig = CFG) -> DataFrame:
    """SCO2: cumulative risk of the entity at every visit."""
    out = entity_history(health)
    risk = S.rule_risk(F.col("cumulative_anomalies"), F.col("health_score"), cfg)
    return out.withColumn("cumulative_risk", risk).withColumn("risk_level", S.risk_level(F.col("cumulative_risk"), cfg))


def rolling_throughput(exits: DataFrame, hours: float, last: int = 200) -> DataFrame:
    """WIN7: completions per hour over the last ``last`` exits.

    Exits are ranked by time, so the earliest of a frame is its first: one row is read for it, not the whole frame.
    """
    ranked = P.ranked(exits, "t", "entity", (), "exit_no")
    framed = P.trailing(
        ranked, "exit_no", last,
        {"_back": lambda w: F.first("t").over(w.rowsBetween(1 - last, 1 - last)), "_start": lambda w: F.first("t").over(w.rowsBetween(Window.unboundedPreceding, 0))},
    )
    n = F.least(F.col("exit_no"), F.lit(last))
    dt = (F.col("t") - F.coalesce("_back", "_start")) * F.lit(hours)
    rate = F.when((n >= 2) & (dt > 0.01), F.round(n / dt, 1)).otherwise(F.lit(0.0))
    return framed.withColumn("rolling_throughput_per_hr", rate).drop("_back", "_start")


def health_steps(health: DataFrame) -> DataFrame:
    """Change of each stage's health at each visit in hundredths, counted from the start value 100.

    The mean of the latest health over all stages is 100 plus the running sum of these steps (WIN9).
    """
    cents = F.round(F.col("health_score") * 100).cast("long")
    framed = P.trailing(
        health.withColumn("_cents", cents), "visit_no", 2,
        {"_first": lambda w: F.first("_cents").over(w), "_k": lambda w: F.count(F.lit(1)).over(w)}, ("stage",),
    )
    previous = F.when(F.col("_k") == 2, F.col("_first")).otherwise(F.lit(10000))
    return framed.withColumn("_step", F.col("_cents") - previous).drop("_first", "_k", "_cents")


def line_overview(health: DataFrame, hours: float, n_stages: int = 7, last: int = 200) -> DataFrame:
    """SCO3: totals, rates, throughput and mean health at every completion (WIN7-9)."""
    flags = {
        "_start": F.col("is_first").cast("int"),
        "_entered": (F.col("is_first") & F.col("is_entry")).cast("int"),
        "_exit": F.col("is_exit").cast("int"),
        "_bad": (F.col("is_exit") & (F.coalesce("response", F.lit(0)) == 1)).cast("int"),
    }
    stepped = health_steps(health).select("entity", "life", "t", message_tie().alias("tie"), "is_exit", *[e.alias(n) for n, e in flags.items()], "_step")
    totals = materialize(
        P.running_rows(materialize(stepped, "steps"), "t", "tie", {**{n: F.col(n) for n in flags}, "_step": F.col("_step")}).where("is_exit"),
        "overview",
    )
    flow = rolling_throughput(totals.select("entity", "t"), hours, last)
    return totals.join(flow, ["entity", "t"]).select(
        "entity", "t",
        (F.col("cum__start") - F.col("cum__exit") + 1).alias("active_parts"),
        F.col("cum__entered").alias("total_entered"),
        F.col("cum__exit").alias("total_completed"),
        F.col("cum__bad").alias("total_defects"),
        F.round(F.col("cum__bad") / F.greatest(F.lit(1), F.col("cum__exit")) * 100.0, 3).alias("cumulative_defect_rate"),
        "rolling_throughput_per_hr",
        F.round(F.lit(100.0) + F.col("cum__step") / F.lit(100.0 * n_stages), 1).alias("line_average_health"),
    )


def critical_alerts(health: DataFrame) -> DataFrame:
    """SCO4: one alert row per visit with critical health."""
    return health.where(F.col("status") == "CRITICAL").select(
        F.lit("STATION_HEALTH_CRITICAL").alias("alert_type"), "entity", "stage", "health_score", "t", "anomalous_features"
    )
