"""Registered queries: each operator on the given tables, with equivalent SQL where SQL can say it."""

import sys

from pyspark import cloudpickle

from catalog import cleaning, exploring, modelling, panels, retrieval, scalars, scans  # noqa: F401
from catalog.base import ORACLES, QUERIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ORACLES", "QUERIES"]
