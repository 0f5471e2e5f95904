"""Column functions: columns in, columns out."""

from answergrid.functions.documents import configure, document, document_of, field_text, kind
from answergrid.functions.matching import make_pattern, matches, pick_value
from answergrid.functions.names import field_names, safe_name
from answergrid.functions.strategies import (
    Strategy,
    applicable,
    coalesce_paths,
    default_strategies,
    direct_field,
    exact_title,
    flexible_array,
    hidden_email,
    nested_list,
    positional,
    strategy_names,
)
from answergrid.functions.text import strip, to_text

__all__ = [
    "Strategy", "applicable", "coalesce_paths", "configure", "default_strategies",
    "direct_field", "document", "document_of", "exact_title", "field_names",
    "field_text", "flexible_array", "hidden_email", "kind", "make_pattern", "matches",
    "nested_list", "pick_value", "positional", "safe_name", "strategy_names", "strip",
    "to_text",
]
