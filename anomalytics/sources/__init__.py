from anomalytics.sources.adapters import testdata_tables, read_raw  # noqa: F401
from anomalytics.sources.readers import (  # noqa: F401
    load_all_tables,
    read_csv,
    read_table,
    register_views,
    table_name,
    table_row_counts,
)
