"""Every window, threshold and grid of a study, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Class names and their reporting order.
CLASS_ORDER = ("CHURN", "CONTRACTION", "STABLE", "EXPANSION", "INSUFFICIENT_DATA")
MODEL_CLASSES = CLASS_ORDER[:4]
MOVEMENT_CLASSES = ("CONTRACTION", "STABLE", "EXPANSION")

# The protocol's run seeds and the renewal-threshold grid size and ends.
RUN_SEEDS = (42, 43, 44, 45, 46)
TAU_GRID = tuple(0.10 + 0.025 * i for i in range(33))

# Daily usage channels of the sequence panel.
PANEL_CHANNELS = ("total_secs", "num_100", "num_unq", "num_25")


@dataclass(frozen=True)
class StudyConfig:
    """Parameters of one study; the defaults are the published ones."""

    cohort_start: str = "2016-08-01"
    cohort_end: str = "2017-01-31"
    window_days: int = 30
    grace_days: int = 30
    late_grace_days: int = 60
    late_grid: tuple[int, ...] = (30, 35, 40, 45, 50, 60)
    min_days: int = 7
    vol_low: float = 0.50
    vol_high: float = 1.50
    horizons: tuple[int, ...] = (1, 7, 14, 30, 60)
    obs_len: int = 30
    cutoffs: tuple[int, ...] = (0, 7, 14, 30, 60)
    seq_window: int = 60
    deep_window: int = 120
    n_folds: int = 5
    holdout_frac: float = 0.15
    min_secs: float = 0.0
    max_secs: float = 86_400.0
    age_build: tuple[int, int] = (10, 90)
    age_use: tuple[int, int] = (0, 100)
    seq_clip: float = 60_000.0

    def __post_init__(self) -> None:
        missing = [c for c in self.cutoffs if c and c not in self.horizons]
        if missing:
            raise ValueError(f"each cutoff needs a horizon of the same length: {missing}")

    def with_(self, **changes) -> "StudyConfig":
        return replace(self, **changes)


# Study over orders / line items: sparse usage over several years.
ORDERS_STUDY = StudyConfig(
    cohort_start="1997-01-01",
    cohort_end="1999-12-31",
    window_days=180,
    min_days=3,
    obs_len=180,
)

# Study over the event stream: dense usage over thirty days.
EVENTS_STUDY = StudyConfig(
    cohort_start="2024-01-09",
    cohort_end="2024-01-22",
    window_days=7,
    grace_days=3,
    late_grace_days=6,
    late_grid=(3, 4, 5, 6),
    min_days=3,
    horizons=(1, 3),
    obs_len=7,
    cutoffs=(0, 1, 3),
    seq_window=6,
    deep_window=12,
)
