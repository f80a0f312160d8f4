"""Curation of channel messages on Spark: select, clean, de-duplicate, publish."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers may not have this package on their path: send its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
