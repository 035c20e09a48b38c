"""Table readers with declared columns, and result sinks."""

from pairlens.sources.files import merge_keep_first, read_csv, write_result
from pairlens.sources.tables import table

__all__ = ["merge_keep_first", "read_csv", "table", "write_result"]
