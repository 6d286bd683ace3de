from anomalytics.functions.columns import (  # noqa: F401
    day_of_week0,
    pct,
    rate_pct,
    safe_div,
    money_text,
    fixed_text,
    count_when,
    sum_when,
    mean_decimal,
    decimals_to_double,
    zscore_bucket,
    day_name,
    hours_after,
)
