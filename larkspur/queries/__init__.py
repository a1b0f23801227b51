from . import domain, evolve, flows, kernel, scopes  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES  # noqa: F401
