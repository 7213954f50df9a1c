"""Raster, frame-sequence and signal analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Ship the small helpers used inside pandas functions with the task itself, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
