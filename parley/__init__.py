"""parley: prepare, score and triage large comment collections on Spark."""

import sys

from pyspark import cloudpickle

from parley.settings import CueTerm, PrepSettings

__all__ = ["CueTerm", "PrepSettings"]

# Functions of this package travel to the workers whole: they need no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
