"""Thresholds and weights. All of them are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

GRAVITY = 9.80665
TRUSTSCORE_VERSION = "v0.3.0"
SCHEMA_VERSION = "0.3"
ARTIFACT_SCHEMA_VERSION = "0.4"
CODES = ("timing_bad", "dropout", "clipping", "gyro_bias_drift", "mag_disturbed", "gps_unreliable", "insufficient_static_segment", "pressure_unstable", "orientation_inconsistent")


@dataclass(frozen=True)
class AuditConfig:
    window_ms: int = 5000
    step_ms: int = 2500
    jitter_warn_ms: float = 4.0
    jitter_fail_ms: float = 8.0
    gap_factor: float = 1.8
    dropout_warn: float = 0.01
    freeze_warn: float = 0.04
    static_acc_std: float = 0.35
    static_gyro_std: float = 0.08
    gravity_residual_warn: float = 1.5
    bias_drift_warn: float = 0.15
    mag_cv_warn: float = 0.25
    pressure_floor_change: float = 18.0
    pressure_unstable: float = 12.0
    gps_valid_warn: float = 0.5
    gps_align_low: float = 0.2
    gps_align_high: float = 1.6
    clipping_warn: float = 0.005
    static_ratio_warn: float = 0.08
    warning: float = 0.8
    fail: float = 0.6
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "timing_bad": 0.14, "dropout": 0.14, "clipping": 0.18, "gyro_bias_drift": 0.12, "mag_disturbed": 0.10,
            "gps_unreliable": 0.08, "insufficient_static_segment": 0.08, "pressure_unstable": 0.08, "orientation_inconsistent": 0.10,
        }
    )
    #: Differences between the chunked audit (the default) and the one in memory.
    own_median_gap: bool = True
    sensor_gates: bool = True
    positive_deltas: bool = True

    @classmethod
    def in_memory(cls, **changes) -> AuditConfig:
        return cls(own_median_gap=False, sensor_gates=False, positive_deltas=False, **changes)


@dataclass(frozen=True)
class ReplayConfig:
    madgwick_gain: float = 0.041
    mahony_kp: float = 0.8
    mahony_ki: float = 0.05
    step_prominence: float = 1.1
    step_min_interval_ms: int = 280
    step_length_m: float = 0.72
    heading_tolerance_ms: int = 250
    trajectory_tolerance_ms: int = 300


@dataclass(frozen=True)
class LimitConfig:
    """Rows of a session at most; 0 is no limit."""

    replay_max_rows: int = 500_000
    benchmark_max_rows: int = 500_000


@dataclass(frozen=True)
class HarConfig:
    window_ms: int = 2000
    step_ms: int = 1000
    min_windows: int = 8
    trees: int = 120
    seed: int = 42
    test_share: float = 0.3
