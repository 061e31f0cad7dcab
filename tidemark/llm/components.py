"""Connected components of a link table (the core's, under the name that the operators of this subpackage use)."""

from tidemark.operators.components import connected_components  # noqa: F401
