"""Parameters of the operators, as frozen dataclasses with the documented defaults."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AttributionConfig:
    lookback_days: int = 30
    # Width of the time cells of the lookback join.  None means "as wide as the lookback",
    # which copies every transaction into at most two cells.
    cell_days: int | None = None
    # Rows of one side of a (user, time cell) that may meet in one place of the lookback join.
    lane_rows: int = 20_000
    # Touchpoints that are ranked, credited and laid out at once when tables are published; whole days.
    slice_rows: int = 4_000_000
    end_share: float = 0.4
    middle_share: float = 0.2
    pair_share: float = 0.5

    @property
    def cell_width_days(self) -> int:
        return self.cell_days or self.lookback_days


@dataclass(frozen=True)
class SkewConfig:
    """From how many rows on a key counts as hot."""

    min_hot_rows: int = 200_000


@dataclass(frozen=True)
class ExperimentWindow:
    """Analysis window of whole Sunday weeks, split into PRE and TEST."""

    start: dt.date = dt.date(2020, 11, 1)
    pre_end: dt.date = dt.date(2020, 12, 26)
    test_start: dt.date = dt.date(2020, 12, 27)
    end: dt.date = dt.date(2021, 1, 30)

    @property
    def week_count(self) -> int:
        return (self.end - self.start).days // 7 + 1

    @property
    def pre_week_count(self) -> int:
        return (self.pre_end - self.start).days // 7 + 1

    @property
    def test_week_count(self) -> int:
        return self.week_count - self.pre_week_count


@dataclass(frozen=True)
class EligibilityThresholds:
    min_active_weeks: int = 8
    min_sessions: int = 500
    min_transactions: int = 20
    min_revenue_usd: float = 1000.0
    max_revenue_cv: float = 2.0


@dataclass(frozen=True)
class DesignSpec:
    name: str
    feature_quantile: float
    correlation_quantile: float
    scale_quantile: float


@dataclass(frozen=True)
class GeoConfig:
    window: ExperimentWindow = field(default_factory=ExperimentWindow)
    thresholds: EligibilityThresholds = field(default_factory=EligibilityThresholds)
    target_country: str = "United States"


# The three candidate designs and the blend of the composite score.
DESIGNS = (
    DesignSpec("CONSERVATIVE", 0.25, 0.50, 0.50),
    DesignSpec("BALANCED", 0.40, 0.40, 0.40),
    DesignSpec("BROAD", 0.50, 0.25, 0.25),
)
COMPOSITE_BLEND = {"feature": 0.50, "session_shape": 0.25, "revenue_shape": 0.25}
