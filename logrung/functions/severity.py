"""Severity scale, mismatch direction and the mismatch score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import literal_map
from logrung.functions.text import strip

# The default scale, its aliases, and the scoring defaults.
DEFAULT_ORDER = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
DEFAULT_ALIASES = {
    "WARNING": "WARN",
    "SEVERE": "ERROR",
    "CRITICAL": "FATAL",
    "UNKNOWN": "INFO",
}
FALLBACK = "INFO"
CRITICAL_FROM = "ERROR"
MATCH, UNDER, OVER = "match", "under_prediction", "over_prediction"
THRESHOLD = 20.0
UNDER_WEIGHT = 1.5
OVER_WEIGHT = 1.0


@dataclass(frozen=True)
class Scale:
    """An ordered list of severities and the names that stand for them."""

    order: tuple[str, ...] = DEFAULT_ORDER
    aliases: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_ALIASES))

    @property
    def span(self) -> int:
        return len(self.order) - 1

    def ranks_by_name(self) -> dict[str, int]:
        """Every name the scale understands with its rank."""
        position = {name: i for i, name in enumerate(self.order)}
        known = {a: position[t] for a, t in self.aliases.items() if t in position}
        # An alias wins over a scale name of the same spelling, and an alias
        # that leads nowhere hides the name.
        lost = {a for a, t in self.aliases.items() if t not in position}
        return {**{n: r for n, r in position.items() if n not in lost}, **known}


DEFAULT_SCALE = Scale()


def severity_rank(label: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    """0-based rank; labels the scale does not know rank as INFO."""
    if FALLBACK not in scale.order:
        fallback = F.raise_error(F.lit(f"scale has no {FALLBACK} to fall back on")).cast("int")
    else:
        fallback = F.lit(scale.order.index(FALLBACK))
    return F.coalesce(
        F.try_element_at(literal_map(scale.ranks_by_name()), strip(F.upper(label))), fallback
    )


def _name_at(rank: Column, scale: Scale) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in scale.order]), rank + 1)


def normalize_severity(label: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    """Canonical name on the scale; everything unknown becomes INFO."""
    known = F.try_element_at(
        literal_map({n: scale.order[r] for n, r in scale.ranks_by_name().items()}),
        strip(F.upper(label)),
    )
    return F.coalesce(known, F.lit(FALLBACK))


def severity_distance(a: Column, b: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    return F.abs(severity_rank(a, scale) - severity_rank(b, scale))


def _direction_of_ranks(observed: Column, predicted: Column) -> Column:
    return (
        F.when(predicted < observed, UNDER).when(predicted > observed, OVER).otherwise(MATCH)
    )


def mismatch_direction(observed: Column, predicted: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    """``under_prediction`` when the prediction is milder than the log line."""
    return _direction_of_ranks(severity_rank(observed, scale), severity_rank(predicted, scale))


def is_critical(label: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    return severity_rank(label, scale) >= severity_rank(F.lit(CRITICAL_FROM), scale)


def is_critical_miss(observed: Column, predicted: Column, scale: Scale = DEFAULT_SCALE) -> Column:
    """A critical line that was predicted at any lower rank."""
    return is_critical(observed, scale) & (
        severity_rank(predicted, scale) < severity_rank(observed, scale)
    )


def flag(distance: Column, score: Column, threshold: Column) -> Column:
    return (distance > 0) & (score >= threshold)


def score_mismatch(
    df: DataFrame,
    observed: str = "observed",
    predicted: str = "predicted",
    confidence: str = "confidence",
    scale: Scale = DEFAULT_SCALE,
    under_weight: float = UNDER_WEIGHT,
    over_weight: float = OVER_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Append the mismatch columns to a table of (observed, predicted, confidence).

    Adds observed_severity, predicted_severity, severity_distance,
    mismatch_direction, risk_weight, anomaly_score, anomaly_threshold and
    is_anomaly. Row-local; no shuffle.
    """
    ranked = df.withColumns(
        {
            "_observed_rank": severity_rank(F.col(observed), scale),
            "_predicted_rank": severity_rank(F.col(predicted), scale),
        }
    )
    o, p = F.col("_observed_rank"), F.col("_predicted_rank")
    weighed = ranked.withColumns(
        {
            "observed_severity": _name_at(o, scale),
            "predicted_severity": _name_at(p, scale),
            "severity_distance": F.abs(o - p),
            "mismatch_direction": _direction_of_ranks(o, p),
            "risk_weight": F.when(p < o, under_weight).when(p > o, over_weight).otherwise(1.0),
        }
    ).drop("_observed_rank", "_predicted_rank")
    share = F.col("severity_distance") / F.lit(float(scale.span)) if scale.span else F.lit(0.0)
    scored = weighed.withColumn(
        "anomaly_score", share * F.col(confidence) * F.col("risk_weight")
    )
    return apply_threshold(scored, F.lit(float(threshold)))


def apply_threshold(scored: DataFrame, threshold: Column) -> DataFrame:
    """Set the threshold column and raise the flag again under it."""
    return scored.withColumn("anomaly_threshold", threshold).withColumn(
        "is_anomaly",
        flag(F.col("severity_distance"), F.col("anomaly_score"), F.col("anomaly_threshold")),
    )
