from anomalytics.streaming.detection import (  # noqa: F401
    event_stream,
    flag_events,
    flagged_rates,
    open_windows,
    stream_flags,
    stream_window_rates,
    windowed_rates,
)
from anomalytics.streaming.monitor import EventMonitor, StatisticsTable  # noqa: F401
