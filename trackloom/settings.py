"""Every analytic threshold, in one frozen object that all operators take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    center_lat: float = 1.35
    center_lon: float = 103.82
    radius_nm: float = 250.0
    poll_seconds: int = 30
    max_position_age_seconds: int = 60
    track_gap_minutes: int = 15
    track_min_points: int = 10
    track_resample_points: int = 64
    good_nic_min: int = 7
    bad_nic_max: int = 5
    cell_deg: float = 0.5
    window_minutes: int = 10
    min_aircraft: int = 4
    bad_fraction: float = 0.5
    hard_loss_nic: int = 0
    hard_loss_nac_p: int = 0
    coarsen_levels: int = 2
    terminal_alt_ft: float = 10_000.0
    gap_min_minutes: float = 10.0
    gap_min_km: float = 50.0
    gap_min_alt_ft: float = 10_000.0
    gap_max_descent_fpm: float = -300.0
    incursion_max_alt_ft: float = 5_000.0
    incursion_gap_minutes: int = 15
    incursion_max_rate_fpm: float = 500.0
    incursion_min_samples: int = 3
    spoof_max_speed_kt: float = 1_400.0
    spoof_min_violations: int = 3
    squawk_codes: tuple[str, ...] = ("7500", "7600", "7700")
    squawk_min_samples: int = 2
    agreement_bonus: float = 0.15
    sensitive_bonus: float = 0.1
    score_track_max_points: int = 4_000
    refresh_hours: int = 6
    outage_failures: int = 3
    pause_floor_seconds: int = 120
    pause_factor: int = 4


DEFAULTS = Settings()
EARTH_RADIUS_KM = 6371.0088
KM_PER_NM = 1.852
MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
