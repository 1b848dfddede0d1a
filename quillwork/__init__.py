"""Spark tables and streams for dictated writing sheets and the type families made from them."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
