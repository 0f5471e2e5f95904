"""Survey-style JSON, cell grids and their history as Spark tables."""

from answergrid.functions import *  # noqa: F401,F403
from answergrid.functions import __all__ as _functions
from answergrid.operators import *  # noqa: F401,F403
from answergrid.operators import __all__ as _operators

__all__ = [*_functions, *_operators]
