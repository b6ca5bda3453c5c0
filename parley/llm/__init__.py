"""Operators for preparing large-scale training text, with their registered queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole: they need no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
