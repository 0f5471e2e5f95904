"""Table operators: DataFrames in, DataFrames out."""

from answergrid.operators.asof import as_of, validity
from answergrid.operators.export import ROW_CAP, as_text, capped, header_of, missing_by_day
from answergrid.operators.fields import fields_as_columns, register_field_table, register_sql_functions
from answergrid.operators.ingest import Header, HeaderNotFound, find_header, import_grid, pack_rows
from answergrid.operators.latest import latest_fields, latest_per_entity, project_fields
from answergrid.operators.many_titles import many_fields
from answergrid.operators.profile import candidate_titles, json_schema, profile_all_paths, profile_json
from answergrid.operators.unnest import (
    distinct_names,
    unnest_entries,
    unnest_pivot,
    unnest_positional,
    unnest_rows,
)

__all__ = [
    "Header", "HeaderNotFound", "ROW_CAP", "as_of", "as_text", "candidate_titles", "capped",
    "distinct_names", "fields_as_columns", "find_header", "header_of", "import_grid",
    "json_schema", "latest_fields", "latest_per_entity", "many_fields", "missing_by_day", "pack_rows",
    "profile_all_paths", "profile_json", "project_fields", "register_field_table", "register_sql_functions", "unnest_entries",
    "unnest_pivot", "unnest_positional", "unnest_rows", "validity",
]
