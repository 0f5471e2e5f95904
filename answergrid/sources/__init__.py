"""Where tables, grids and histories come from and go to."""

from answergrid.sources.grids import import_files, parse_range, read_export, read_grid, write_grid
from answergrid.sources.history import (
    HISTORY_SCHEMA,
    HistoryMismatch,
    append_history,
    append_history_files,
    ensure_history,
    read_history_files,
)
from answergrid.sources.loads import append_load, commit_load, loads_of, read_latest, read_loads, refresh_latest, write_load
from answergrid.sources.metrics import Run
from answergrid.sources.shared import new_path, shared_dir
from answergrid.sources.tables import jdbc_options, read_jdbc, read_query, spread

__all__ = [
    "HISTORY_SCHEMA", "HistoryMismatch", "Run", "append_history", "append_history_files",
    "append_load", "commit_load",
    "ensure_history", "import_files", "jdbc_options", "loads_of", "new_path", "parse_range", "read_export", "read_grid",
    "read_history_files", "read_jdbc", "read_latest", "read_loads", "read_query", "refresh_latest", "shared_dir", "spread",
    "write_grid", "write_load",
]
