"""Thresholds of the price-comparison rules.  Fixed values; results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PricingRules:
    """Limits used by offers, guards, history and freshness."""

    floor: float = 10.0
    currency: str = "EGP"
    fresh_minutes: int = 735
    stale_minutes: int = 1470
    min_ratio_to_previous: float = 0.20
    max_ratio_to_previous: float = 5.00
    history_days: int = 90
    recent_days: int = 30
    sparkline_days: int = 30
    marker_limit: int = 20


@dataclass(frozen=True)
class MatchRules:
    """Score thresholds of catalogue matching."""

    direct: float = 40.0
    listing: float = 55.0
    automatic: float = 95.0
    review: float = 70.0
    margin: float = 8.0
    conflict: float = -1000.0
    fuzzy_threshold: float = 0.18
    fuzzy_limit: int = 12
    provisional_min_stores: int = 2


@dataclass(frozen=True)
class SkewRules:
    """When and how one key's rows are cut into slices.

    Prefix scans cut every key at fixed places: each ``slice_days`` days of a
    time, ``slices_per_octave`` steps for each doubling of a number.  For replays:
    A key is hot when it holds more than ``1 / max_hot_keys`` of all rows and
    more than ``min_rows`` rows, so there can never be more than
    ``max_hot_keys`` hot keys, whatever the data size.
    """

    max_hot_keys: int = 4096
    min_rows: int = 1_000_000
    slices: int = 1024
    slice_days: int = 90
    slices_per_octave: int = 16


PRICING = PricingRules()
MATCHING = MatchRules()
SKEW = SkewRules()


@dataclass(frozen=True)
class RunSchedule:
    """Local refresh hours and the zone they are written in."""

    hours: tuple[int, ...] = (10, 20)
    timezone: str = "Africa/Cairo"
    catalog_hour: int = 2
    catalog_minute: int = 30


SCHEDULE = RunSchedule()


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of the decision score and of the safety score."""

    decision: dict[str, float] = field(
        default_factory=lambda: {
            "price": 0.27,
            "store": 0.15,
            "shipping": 0.08,
            "availability": 0.12,
            "warranty": 0.10,
            "freshness": 0.10,
            "match": 0.13,
            "market_coverage": 0.05,
        }
    )
    safety: dict[str, float] = field(
        default_factory=lambda: {
            "store": 0.27,
            "warranty": 0.22,
            "availability": 0.18,
            "freshness": 0.13,
            "match": 0.20,
        }
    )


WEIGHTS = ScoreWeights()
