"""Column-expression versions of the inventory, expiry and supplier rules.

Each rule is a function of Columns returning a Column, so it runs inside
whole-stage codegen on every row of a position or batch table.  Invalid inputs
(negative quantities, too little history) give NULL by default, which a batch
job routes to a reject output; ``strict=True`` raises instead, like the
single-value calculators of the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ceil_clean, col

# Tier labels, thresholds and label sets shown to users.
CRITICAL, HIGH, WATCH, HEALTHY = "Critical", "High", "Watch", "Healthy"
TIER_ORDER = (CRITICAL, HIGH, WATCH, HEALTHY)
WATCH_WEEKS = 6
REVIEW_PERIOD_WEEKS = 4
SERVICE_Z = 1.65
DEMAND_WINDOW_DAYS = 84

EXPIRED, D90, D180, D365, OVER365 = "Expired", "0-90 days", "91-180 days", "181-365 days", "Over 365 days"
BUCKET_ORDER = (EXPIRED, D90, D180, D365, OVER365)

# FEFO action labels of the SQL query library.
FEFO_ACTIONS_SQL = (
    "Quarantine and disposition",
    "Transfer, return, or prioritize allocation",
    "Monitor weekly",
    "No immediate action",
)
# FEFO action labels of the expiry page (batches within 365 days).
FEFO_ACTIONS_PAGE = (
    "Quarantine / disposition",
    "Prioritize allocation / transfer",
    "Monitor weekly",
    "Monitor monthly",
)

NEEDS_ACTION, MONITOR, PREFERRED = "Needs Action", "Monitor", "Preferred"
SCORE_WEIGHTS = (0.45, 0.30, 0.25)  # on-time, acceptance quality, fill rate
SCORE_BINS = (85, 92)  # right-closed: (-inf, 85], (85, 92], (92, inf)
SERVICE_GOOD_PCT = 97
ON_TIME_GOOD_PCT = 92


def _guard(value: Column, invalid: Column, message: str, strict: bool) -> Column:
    if strict:
        return F.when(invalid, F.raise_error(F.lit(message))).otherwise(value)
    return F.when(~invalid, value)


def stockout_tier(inventory: str | Column, safety: str | Column, reorder: str | Column, coverage: str | Column) -> Column:
    """Critical / High / Watch / Healthy.  ``coverage`` NULL or infinite -> not Watch."""
    inv, cov = col(inventory), col(coverage)
    return (
        F.when(inv <= col(safety), F.lit(CRITICAL))
        .when(inv <= col(reorder), F.lit(HIGH))
        .when(cov.isNotNull() & (cov < WATCH_WEEKS), F.lit(WATCH))
        .otherwise(F.lit(HEALTHY))
    )


def tier_rank(tier: str | Column) -> Column:
    t = col(tier)
    return F.when(t == CRITICAL, 1).when(t == HIGH, 2).when(t == WATCH, 3).otherwise(4)


def coverage_weeks(inventory: str | Column, avg_demand: str | Column, zero_demand: str = "null", strict: bool = False) -> Column:
    """Weeks of supply.  Zero demand gives NULL (view) or +inf (calculator)."""
    inv, avg = col(inventory).cast("double"), col(avg_demand).cast("double")
    zero = F.lit(float("inf")) if zero_demand == "inf" else F.lit(None).cast("double")
    value = F.when(avg == 0, zero).otherwise(inv / F.when(avg != 0, avg))
    return _guard(value, (inv < 0) | (avg < 0), "Inventory and demand must be non-negative", strict)


def safety_stock(demand_stddev: str | Column, observations: str | Column, lead_weeks: str | Column,
                 z: float = SERVICE_Z, strict: bool = False) -> Column:
    """ceil(z * sample stddev * sqrt(lead weeks)); needs >= 2 observations."""
    if z < 0:
        raise ValueError("Service-level z-score cannot be negative")
    lead = col(lead_weeks).cast("double")
    value = ceil_clean(F.lit(z) * col(demand_stddev) * F.sqrt(lead))
    invalid = (col(observations) < 2) | (lead <= 0)
    return _guard(value, invalid, "At least two demand observations and a positive lead time are required", strict)


def safety_stock_reject_reason(observations: str | Column, lead_weeks: str | Column) -> Column:
    return (
        F.when(col(observations) < 2, F.lit("At least two demand observations are required"))
        .when(col(lead_weeks) <= 0, F.lit("Lead time must be positive"))
    )


def reorder_point(avg_demand: str | Column, lead_weeks: str | Column, safety: str | Column, strict: bool = False) -> Column:
    """ceil(avg demand * lead weeks + safety stock)."""
    avg, lead, ss = col(avg_demand).cast("double"), col(lead_weeks).cast("double"), col(safety)
    invalid = (avg < 0) | (lead < 0) | (ss < 0)
    return _guard(ceil_clean(avg * lead + ss), invalid, "Demand, lead time, and safety stock must be non-negative", strict)


def order_up_to_quantity(inventory: str | Column, avg_demand: str | Column, lead_weeks: str | Column,
                         safety: str | Column, review_weeks: float = REVIEW_PERIOD_WEEKS, strict: bool = False) -> Column:
    """max(0, ceil(avg * (lead + review) + safety - inventory)) (no open-PO netting)."""
    inv, avg, lead, ss = (col(c).cast("double") for c in (inventory, avg_demand, lead_weeks, safety))
    target = avg * (lead + F.lit(float(review_weeks))) + ss
    value = F.greatest(F.lit(0).cast("bigint"), ceil_clean(target - inv))
    invalid = (inv < 0) | (avg < 0) | (lead < 0) | (ss < 0) | F.lit(review_weeks < 0)
    return _guard(value, invalid, "Replenishment inputs must be non-negative", strict)


def expiry_bucket(days_to_expiry: str | Column) -> Column:
    """Shelf-life band; upper bounds inclusive; NULL falls to 'Over 365 days'."""
    d = col(days_to_expiry)
    return (
        F.when(d < 0, F.lit(EXPIRED))
        .when(d <= 90, F.lit(D90))
        .when(d <= 180, F.lit(D180))
        .when(d <= 365, F.lit(D365))
        .otherwise(F.lit(OVER365))
    )


def bucket_rank(bucket: str | Column) -> Column:
    b = col(bucket)
    return F.when(b == EXPIRED, 1).when(b == D90, 2).when(b == D180, 3).when(b == D365, 4).otherwise(5)


def fefo_action(days_to_expiry: str | Column, labels: tuple[str, str, str, str] = FEFO_ACTIONS_SQL) -> Column:
    d = col(days_to_expiry)
    return (
        F.when(d < 0, F.lit(labels[0]))
        .when(d <= 90, F.lit(labels[1]))
        .when(d <= 180, F.lit(labels[2]))
        .otherwise(F.lit(labels[3]))
    )


def weighted_score(on_time: str | Column, quality: str | Column, fill: str | Column, nulls_as_zero: bool) -> Column:
    """0.45 * on-time + 0.30 * quality + 0.25 * fill, rounded to 1 decimal.

    Computed on decimals so the rounding of ties is exact.  With
    ``nulls_as_zero`` a missing metric contributes 0 (row sum that skips NaN);
    otherwise any missing metric makes the score NULL.
    """
    parts = []
    for c, w in zip((on_time, quality, fill), SCORE_WEIGHTS):
        v = col(c).cast("decimal(10,1)")
        if nulls_as_zero:
            v = F.coalesce(v, F.lit(0).cast("decimal(10,1)"))
        parts.append(v * F.lit(str(w)).cast("decimal(3,2)"))
    return F.round(parts[0] + parts[1] + parts[2], 1).cast("double")


def score_tier(score: str | Column) -> Column:
    s = col(score)
    return F.when(s <= SCORE_BINS[0], F.lit(NEEDS_ACTION)).when(s <= SCORE_BINS[1], F.lit(MONITOR)).when(
        s.isNotNull(), F.lit(PREFERRED)
    )
