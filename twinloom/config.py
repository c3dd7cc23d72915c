"""Thresholds that define results, and the version strings that make cached results valid."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Thresholds:
    """The defaults of the decision model."""

    theta_a: float = 0.80
    theta_a_low: float = 0.30
    min_overlap_s: float = 60.0
    items_per_s: float = 8.0
    max_audio_offset: int = 2400
    fp_max_s: float = 600.0
    fp_cap_above_s: float = 3600.0
    theta_v: float = 0.75
    theta_v_high: float = 0.85
    min_coverage: float = 0.70
    min_coverage_long: float = 0.5
    min_strong_duration_s: float = 15.0
    fps: float = 2.0
    max_offset_s: float = 300.0
    gap_penalty: float = 0.3
    match_threshold: float = 0.5
    theta_s: float = 0.70
    theta_s_high: float = 0.80
    min_cut_density: float = 0.04
    superset_min_extra_ratio: float = 0.08
    knn_k: int = 25
    n_window_vecs: int = 12
    window_k: int = 10
    duration_tolerance: float = 0.03
    cosine_gate: float = 0.7
    seek_threshold_gb: float = 6.0
    seek_height: int = 4320
    grid_step_s: float = 2.0
    scene_cut: float = 0.6
    dtw_band_frac: float = 0.2
    dtw_gap: float = 0.2
    dtw_min_band: int = 25
    audio_ok: float = 0.85
    audio_tolerance: float = 0.05
    grade_divergence: float = 0.15
    clip_margin: float = 0.05
    clip_weight: float = 1e6
    ad_interleaved_min: float = 0.02
    min_ad_s: float = 5.0
    min_ad_run_s: float = 10.0
    mtime_tolerance_s: float = 2.0
    settle_s: float = 15.0

    def override(self, **values: float) -> Thresholds:
        return replace(self, **values)


#: Raised when the decision expression changes, so that cached decisions are made anew.
DECISION_VERSION = 2
MODEL_VERSION = "features-1"


def fingerprint(th: Thresholds, feature_version: str = MODEL_VERSION) -> str:
    """Names the decisions that a ledger holds: features, thresholds and decision version."""
    body = json.dumps({"features": feature_version, "decision": DECISION_VERSION, **asdict(th)}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def feature_version(model: str, dim: int, fps: float, audio_cap_s: float, scene_mode: str) -> str:
    return f"{model}|d{dim}|fps{fps:g}|audio{audio_cap_s:g}|{scene_mode}"


def load(default: str | None = None, override: str | None = None) -> Thresholds:
    """Thresholds from JSON files of fields; the override's fields win over the default file's, and both over the built-in ones.
    Files that are missing count as empty; an unknown field is an error."""
    values: dict[str, float] = {}
    for path in (default, override):
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                values |= json.load(f)
    return Thresholds(**values)


def save_override(path: str, **values: float) -> Thresholds:
    """Adds fields to an override file, written whole and then renamed; the thresholds that now hold."""
    known: dict[str, float] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    Thresholds(**(known | values))  # fields are checked before anything is written
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(known | values, f, sort_keys=True)
    os.replace(f"{path}.new", path)
    return load(override=path)
