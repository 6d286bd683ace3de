"""Fixed values that results depend on.

Every number and label below must equal the reference's so that flags,
buckets and names come out the same. They are kept together here as plain
values; operators take a ``Thresholds`` so a caller can override them.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (must equal the reference) --------------------------------
IQR_MULTIPLIER = 1.5            # amount_flag fences: q1 - 1.5*IQR, q3 + 1.5*IQR
EXTREME_IQR_MULTIPLIER = 3.0    # extreme_flag fences: q1 - 3*IQR, q3 + 3*IQR
UNUSUAL_HOUR_FIRST = 2          # time_flag: hour BETWEEN 2 AND 5 (both ends in)
UNUSUAL_HOUR_LAST = 5
MAX_NORMAL_INSTALLMENTS = 10    # installment_flag: installments > 10
MAX_NORMAL_ITEMS = 5            # size_flag: items > 5
ZSCORE_OUTLIER = 3.0            # documented z-score method: abs(z) > 3
DELIVERED_STATUS = "delivered"
CONTAMINATION = 0.05
N_TREES = 100
FOREST_SEED = 42
MAX_SAMPLES = 256
TOP_ANOMALOUS_LIMIT = 100
TOP_STATES_LIMIT = 12
DETAIL_LIMIT = 100
HISTOGRAM_BINS = 50

LABEL_NORMAL = "NORMAL"
LABEL_HIGH_AMOUNT = "HIGH_AMOUNT"
LABEL_LOW_AMOUNT = "LOW_AMOUNT"
LABEL_EXTREME_HIGH = "EXTREME_HIGH"
LABEL_EXTREME_LOW = "EXTREME_LOW"
LABEL_UNUSUAL_HOUR = "UNUSUAL_HOUR"
LABEL_HIGH_INSTALLMENTS = "HIGH_INSTALLMENTS"
LABEL_LARGE_ORDER = "LARGE_ORDER"

# anomaly_type labels of the detector, in the order they are applied
TYPE_NORMAL = "Normal"
TYPE_ML = "ML Detected"
TYPE_STATISTICAL = "Statistical Outlier"
TYPE_HIGH_CONFIDENCE = "High Confidence Anomaly"

# weekday names, 0 = Sunday
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# z-score buckets: (upper bound exclusive, label); the last label takes the rest
ZSCORE_BUCKETS = (
    (-3.0, "< -3 (Extreme Low)"),
    (-2.0, "-3 to -2 (Very Low)"),
    (-1.0, "-2 to -1 (Low)"),
    (1.0, "-1 to 1 (Normal)"),
    (2.0, "1 to 2 (High)"),
    (3.0, "2 to 3 (Very High)"),
)
ZSCORE_TOP_BUCKET = ">= 3 (Extreme High)"

# detail table headers of the dashboard
DETAIL_HEADERS = ("Order ID", "State", "Amount", "Items", "Installments", "Hour", "Anomaly Score", "Type")

# feature columns of the detector
FEATURE_COLUMNS = ("total_amount", "total_items", "payment_installments", "hour_of_day", "day_of_week")
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    iqr_multiplier: float = IQR_MULTIPLIER
    extreme_multiplier: float = EXTREME_IQR_MULTIPLIER
    unusual_hour_first: int = UNUSUAL_HOUR_FIRST
    unusual_hour_last: int = UNUSUAL_HOUR_LAST
    max_normal_installments: int = MAX_NORMAL_INSTALLMENTS
    max_normal_items: int = MAX_NORMAL_ITEMS
    zscore_outlier: float = ZSCORE_OUTLIER


DEFAULT_THRESHOLDS = Thresholds()
