"""Connected components, as the rest of the library has them."""

from ..operators.components import components  # noqa: F401
