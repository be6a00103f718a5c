"""Column expressions: name parsing, banding, sub-scores, risk formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming pattern of wide columns and the topic layout.
COLUMN_PATTERN = r"^L(\d+)_S(\d+)_([FD])(\d+)$"
TOPIC_PREFIX = ("factory", "line3")
TOPICS = {
    "telemetry": "factory/line3/{}/telemetry",
    "health": "factory/line3/{}/health",
    "part_risk": "factory/line3/parts/{}/risk",
    "overview": "factory/line3/overview",
    "alerts": "factory/line3/alerts",
    "ai_part_risk": "twin/ai/part_risk",
    "ai_window": "twin/ai/window",
    "ai_anomaly": "twin/ai/anomaly",
}


@dataclass(frozen=True)
class ScoreConfig:
    """Weights and thresholds of the health and risk scores (fixed values, overridable)."""

    base_rate: float = 0.005069
    drift_weight: float = 0.45
    pacing_weight: float = 0.30
    defect_weight: float = 0.25
    healthy: float = 80.0
    warning: float = 50.0
    z_threshold: float = 3.0
    window: int = 100
    anomaly_weight: float = 0.50
    health_penalty_weight: float = 0.30
    anomaly_step: float = 0.22
    low_risk: float = 0.30
    high_risk: float = 0.70
    default_p90: float = 6.0238
    default_p99: float = 36.1060
    model_rule: float = 0.30
    model_health: float = 0.20
    model_prob: float = 0.20
    model_base: float = 0.00507
    high_prob: float = 0.05


def round_half_up(x: Column, digits: int) -> Column:
    """Round in decimal arithmetic, so that ties do not depend on the binary form of the value."""
    return F.round(x.cast("decimal(18,10)"), digits).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def parse_column(name: Column) -> dict[str, Column]:
    """line, station, kind and id of a wide column name; kind is 'Other' for any other name."""
    matched = F.regexp_extract(name, COLUMN_PATTERN, 3) != ""

    def part(i: int) -> Column:
        return F.when(matched, F.regexp_extract(name, COLUMN_PATTERN, i).cast("int"))

    kind = F.regexp_extract(name, COLUMN_PATTERN, 3)
    return {
        "line": part(1),
        "station": part(2),
        "kind": F.when(kind == "F", "Feature").when(kind == "D", "Date").otherwise("Other"),
        "feature_id": part(4),
    }


def topic_stage(topic: Column) -> Column:
    """Third segment of a station topic, empty for other topics."""
    parts = F.split(topic, "/")
    ok = (F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == TOPIC_PREFIX[0]) & (F.get(parts, F.lit(1)) == TOPIC_PREFIX[1])
    return F.when(ok, F.get(parts, F.lit(2))).otherwise("")


def clipped_transit(entry: Column, previous: Column, minutes: float) -> Column:
    """Minutes since the previous visit, never negative, 0 where there is none."""
    return F.coalesce(F.greatest(F.lit(0.0), (entry - previous) * F.lit(minutes)), F.lit(0.0))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, 0 for an unknown feature or a missing value."""
    return F.coalesce((x - mean) / std, F.lit(0.0))


def abs_z(x: Column, mean: Column, std: Column, floor: float = 0.001) -> Column:
    return F.abs((x - mean) / F.greatest(std, F.lit(floor)))


def drift_score(avg_z: Column, n_features: Column) -> Column:
    return F.when(n_features > 0, clamp(F.lit(100.0) - (avg_z - 1.0) * F.lit(100.0 / 3.0), 0.0, 100.0)).otherwise(F.lit(100.0))


def pacing_score(transit: Column, p90: Column, p99: Column, has_previous: Column) -> Column:
    between = F.lit(100.0) - F.lit(40.0) * (transit - p90) / F.greatest(F.lit(0.001), p99 - p90)
    beyond = F.greatest(F.lit(0.0), F.lit(60.0) - F.lit(60.0) * (transit - p99) / F.greatest(F.lit(1.0), p99))
    return F.when(~has_previous, F.lit(100.0)).when(transit <= p90, F.lit(100.0)).when(transit <= p99, between).otherwise(beyond)


def defect_score(observed: Column, base: Column) -> Column:
    ratio = observed / F.greatest(F.lit(1e-5), base)
    return (
        F.when(ratio <= 1.0, F.lit(100.0))
        .when(ratio <= 3.0, F.lit(100.0) - F.lit(50.0) * (ratio - 1.0) / 2.0)
        .otherwise(F.greatest(F.lit(0.0), F.lit(50.0) - F.lit(50.0) * (ratio - 3.0) / 4.0))
    )


def composite_health(drift: Column, pacing: Column, defect: Column, cfg: ScoreConfig) -> Column:
    mix = drift * cfg.drift_weight + pacing * cfg.pacing_weight + defect * cfg.defect_weight
    return round_half_up(clamp(mix, 0.0, 100.0), 2)


def health_status(health: Column, cfg: ScoreConfig) -> Column:
    return F.when(health >= cfg.healthy, "HEALTHY").when(health >= cfg.warning, "WARNING").otherwise("CRITICAL")


def rule_risk(anomalies: Column, health: Column, cfg: ScoreConfig) -> Column:
    feature_part = F.least(F.lit(1.0), anomalies * cfg.anomaly_step)
    health_part = F.greatest(F.lit(0.0), (F.lit(100.0) - health) / 100.0)
    total = cfg.anomaly_weight + cfg.health_penalty_weight
    raw = (feature_part * cfg.anomaly_weight + health_part * cfg.health_penalty_weight) / F.lit(total)
    return round_half_up(clamp(raw, cfg.base_rate, 0.99), 4)


def risk_level(risk: Column, cfg: ScoreConfig) -> Column:
    return F.when(risk < cfg.low_risk, "LOW").when(risk < cfg.high_risk, "MEDIUM").otherwise("HIGH")


def blended_risk(rule: Column, health: Column, prob: Column, cfg: ScoreConfig) -> Column:
    lift = clamp((prob / cfg.model_base - 1.0) / 4.0, 0.0, 1.0)
    mix = rule * cfg.model_rule + (F.lit(1.0) - health / 100.0) * cfg.model_health + lift * cfg.model_prob
    return round_half_up(clamp(mix, 0.0, 1.0), 3)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def missing_flag(x: Column) -> Column:
    return x.isNull().cast("int")


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den, ``default`` (null if not given) where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def contains_path(route: Column, path: str, sep: str = "->") -> Column:
    """The route holds ``path`` as whole consecutive steps (S3 does not match inside S37)."""
    return F.concat(F.lit(sep), route, F.lit(sep)).contains(f"{sep}{path}{sep}")


def half_bin(t: Column) -> Column:
    return F.floor(t * 2) / F.lit(2.0)


def in_interval(t: Column, start: Column, stop: Column, closed: str = "both") -> Column:
    """Membership in [start, stop] (``both``) or [start, stop) (``left``)."""
    if closed == "both":
        return (t >= start) & (t <= stop)
    if closed == "left":
        return (t >= start) & (t < stop)
    raise ValueError(f"unknown interval kind {closed!r}")
