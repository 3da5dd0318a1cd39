"""The registered queries."""

from . import catalog, further  # noqa: F401  (queries register as these are read)
