"""Sources and sinks."""

from .adapter import raw_applications, table_vectors  # noqa: F401
from .raw import RAW_SCHEMA, SOURCE_KEY, read_raw_csv, reject_counts, scan_raw_csv, with_content_key  # noqa: F401
from .sinks import create_table, create_view, read_replaced, replace_table, stage_table, write_table  # noqa: F401
from .tables import TABLES, read_table, table_path  # noqa: F401
