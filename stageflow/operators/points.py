"""Messages to time-series points: (measurement, ts, seq, tags, fields)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Measurement:
    """How one kind of message becomes a point.  ``None`` as a field default marks an optional field."""

    name: str
    topic: str
    tags: Mapping[str, str]
    fields: Mapping[str, float | None]
    constant_tags: Mapping[str, str] = field(default_factory=dict)
    maps: Mapping[str, str] = field(default_factory=dict)


# Topic fragment, tags and fields with their defaults.  The first fragment found in a topic decides.
MEASUREMENTS = (
    Measurement(
        "ai_part_risk", "twin/ai/part_risk",
        {"part_id": "0", "station_id": "S35", "branch": "0", "scenario_model": "general", "is_high_risk": "False"},
        {"predicted_defect_prob": 0.0, "decision_time": 0.0, "raw_defect_prob": None, "ground_truth_response": None},
    ),
    Measurement(
        "ai_window", "twin/ai/window", {"station_id": "S29"},
        {"throughput": 0.0, "zero_delta_share": 0.0, "max_abs_z": 0.0, "mean_abs_z": 0.0, "p90_transit": 0.0},
    ),
    Measurement(
        "ai_anomaly", "twin/ai/anomaly", {"scenario_model": "general", "is_anomaly": "False"},
        {"anomaly_score": 0.0, "threshold_p99": 0.0}, maps={"station_contributions": "attr_"},
    ),
    Measurement(
        "station_telemetry", "telemetry", {"station_id": "None", "is_entry": "False", "is_exit": "False"},
        {"part_id": 0.0, "sim_time": 0.0, "sim_time_hours": 0.0, "transit_minutes": 0.0, "response": None},
        {"line_id": "3"}, {"features": ""},
    ),
    Measurement(
        "station_health", "health", {"station_id": "None", "status": "HEALTHY"},
        {"health_score": 100.0, "feature_drift_score": 100.0, "transit_pacing_score": 100.0, "defect_rate_score": 100.0,
         "active_features_count": 0.0, "parts_processed_window": 0.0, "observed_defect_rate": 0.0},
    ),
    Measurement(
        "part_risk", "risk", {"part_id": "None", "current_station": "None", "risk_level": "LOW"},
        {"cumulative_risk": 0.0, "cumulative_anomalies": 0.0, "ground_truth_response": None},
    ),
    Measurement(
        "line_overview", "overview", {},
        {"active_parts_in_line": 0.0, "total_parts_entered": 0.0, "total_parts_completed": 0.0, "total_defects_observed": 0.0,
         "cumulative_defect_rate": 0.0, "rolling_throughput_per_hr": 0.0, "line_average_health": 100.0},
        {"line_id": "3"},
    ),
)


def payload_schema() -> T.StructType:
    """All keys any message may carry; tags are read as text, fields as numbers."""
    kinds: dict[str, T.DataType] = {}
    for m in MEASUREMENTS:
        kinds.update({t: T.StringType() for t in m.tags})
        kinds.update({f: T.DoubleType() for f in m.fields if f not in kinds})
        kinds.update({k: T.MapType(T.StringType(), T.DoubleType()) for k in m.maps})
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def _text(c: Column) -> Column:
    return F.when(c == "true", "True").when(c == "false", "False").otherwise(c)


def _present(values: Column) -> Column:
    """A map without its null values; empty for a null map."""
    return F.coalesce(F.map_filter(values, lambda _, v: v.isNotNull()), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k)) if prefix else names


def _field_map(m: Measurement) -> Column:
    """The fields that have a value, as arrays of names and numbers that become one map: only optional fields and the message's own maps are tested for nulls."""
    number = lambda n: F.col(n).cast("double")
    fixed = {n: F.coalesce(number(n), F.lit(float(d))) for n, d in m.fields.items() if d is not None}
    names, nums = [F.array(*[F.lit(n) for n in fixed]).cast("array<string>")], [F.array(*fixed.values()).cast("array<double>")]
    for n in (n for n, d in m.fields.items() if d is None):
        names.append(F.when(number(n).isNotNull(), F.array(F.lit(n))).otherwise(F.array().cast("array<string>")))
        nums.append(F.when(number(n).isNotNull(), F.array(number(n))).otherwise(F.array().cast("array<double>")))
    for source, prefix in m.maps.items():
        names.append(_prefixed(F.map_keys(F.col(f"_{source}")), prefix))
        nums.append(F.map_values(F.col(f"_{source}")))
    return F.map_from_arrays(F.concat(*names), F.concat(*nums))


def to_points(
    messages: DataFrame, topic: str = "topic", payload: str = "payload", ts: str = "ts", seq: str = "seq", names: Sequence[str] | None = None
) -> DataFrame:
    """SNK5: one parse per message and no union; topics without a measurement are dropped.  Works on streams.

    ``names``: the measurements wanted, where the caller knows them; only their keys are parsed, and messages of others are dropped as well.
    ``inline`` keeps the parsed struct from being merged into (and repeated by) later expressions. The two maps are plain columns, which compile; one that
    nobody reads is not made.
    """
    kind = F.lit(None).cast("string")
    for m in reversed(MEASUREMENTS):
        kind = F.when(F.col(topic).contains(m.topic), m.name).otherwise(kind)
    wanted = [m for m in MEASUREMENTS if names is None or m.name in names]
    keys = {k for m in wanted for k in (*m.tags, *m.fields, *m.maps)}
    schema = T.StructType([f for f in payload_schema() if f.name in keys])
    parsed = messages.withColumn("measurement", kind).where(F.col("measurement").isin([m.name for m in wanted])).select(
        "measurement", F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.inline(F.array(F.from_json(payload, schema)))
    )
    parsed = parsed.withColumns({f"_{s}": _present(F.col(s)) for m in wanted for s in m.maps})
    tags: Column = F.lit(None)
    fields: Column = F.lit(None)
    for m in wanted:
        here = F.col("measurement") == m.name
        names = [F.lit(n) for n in (*m.constant_tags, *m.tags)]
        values = [F.lit(v) for v in m.constant_tags.values()] + [F.coalesce(_text(F.col(t)), F.lit(d)) for t, d in m.tags.items()]
        tag_map = F.map_from_arrays(F.array(*names), F.array(*values)) if names else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        tags = F.when(here, tag_map).otherwise(tags)
        fields = F.when(here, _field_map(m)).otherwise(fields)
    return parsed.select("measurement", F.col("_ts").alias("ts"), F.col("_seq").alias("seq"), tags.alias("tags"), fields.alias("fields"))


def message(df: DataFrame, topic: Column, ts: Column, seq: Column, **keys: Column) -> DataFrame:
    """SNK4: (topic, ts, seq, payload) rows with the given payload keys."""
    return df.select(topic.alias("topic"), ts.alias("ts"), seq.alias("seq"), F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()])).alias("payload"))


def series(points: DataFrame, measurement: str, name: str, tags: Sequence[str] = ()) -> DataFrame:
    """One field of one measurement as (ts, seq, tags..., value); the map is read directly, not exploded."""
    value = F.col("fields")[name]
    return points.where((F.col("measurement") == measurement) & value.isNotNull()).select(
        "ts", "seq", *[F.col("tags")[t].alias(t) for t in tags], value.alias("value")
    )
