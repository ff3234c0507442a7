"""Every registered query of the core, and its SQL twin."""

from rallygrid.plans import betting, core_problems, details, learning, players, relational, served

_MODULES = (core_problems, players, relational, betting, details, learning, served)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
