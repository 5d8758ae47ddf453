"""Versions, weights and thresholds of the scores, as plain data."""

from __future__ import annotations

BURST = {
    "version": "CONTENT_BURST_V1",
    "weights": {"velocity": 0.35, "reach": 0.20, "engagement_quality": 0.20, "relative": 0.15, "structure": 0.10},
    "windows_hours": {"6h": 6, "24h": 24, "72h": 72, "7d": 168},
    "fallback": ("24h", "72h", "7d"),
    "age_buckets": (("0-6h", 6), ("6-24h", 24), ("1-3d", 72), ("3-7d", 168), ("7-30d", 720), ("30d+", None)),
    "min_sample": 30,
    "floor_sample": 5,
    "creator_min_history": 5,
}
TREND = {
    "version": "TOPIC_TREND_V1",
    "weights": {"content_growth": 0.35, "engagement_growth": 0.25, "creator_growth": 0.15, "burst_density": 0.15, "acceleration": 0.10},
    "window_hours": 168,
    "burst_threshold": 80,
    "min_members": 3,
}
LIFECYCLE = {
    "emerging_max_age_days": 3, "emerging_max_members": 30, "rising_trend_min": 60, "peak_min_members": 20, "peak_min_density": 0.25,
    "peak_trend_min": 70, "saturated_band": (0.4, 1.6), "saturated_min_members": 30, "declining_trend_max": 40, "declining_low": 2,
    "evergreen_min_age_days": 30, "evergreen_max_volatility": 8, "confirmations": 2, "strong_jump": 25,
}
PATTERN = {"version": "VIRAL_PATTERN_V1", "viral_threshold": 80, "min_viral": 8, "min_control": 15, "high": 30, "medium": 10}
SATURATION = {
    "version": "SATURATION_V1",
    "weights": {"volume": 0.20, "frequency": 0.20, "angle_similarity": 0.25, "repetition": 0.20, "concentration": 0.15},
    "volume_per_day": 1.5, "frequency_per_day": 1.0, "repetition_at": 0.7, "most_members": 300, "min_members": 5,
}
NOVELTY = {
    "version": "NOVELTY_V1",
    "weights": {"distance": 0.40, "growth": 0.25, "adequacy": 0.20, "diversity": 0.15},
    "same_angle": 0.6, "identity": 0.6, "new_below": 0.5, "min_members": 3, "recent_days": 7,
}
OPPORTUNITY = {
    "version": "TOPIC_OPPORTUNITY_V1",
    "balanced": {"trend": 0.30, "burst": 0.20, "novelty": 0.15, "whitespace": 0.15, "pattern": 0.10, "lifecycle": 0.10},
    "early_discovery": {"trend": 0.25, "burst": 0.15, "novelty": 0.25, "whitespace": 0.20, "pattern": 0.05, "lifecycle": 0.10},
    "lifecycle_fit": {"emerging": 65, "rising": 85, "peak": 70, "saturated": 45, "declining": 25, "evergreen": 55},
    "burst_mix": {"density": 0.5, "p75": 0.3, "recent": 0.2},
    "min_components": 3, "high": 70, "medium": 40, "few_members": 10, "low_coverage": 0.5, "trend_max_age_hours": 24, "intel_max_age_hours": 48,
}
