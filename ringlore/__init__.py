"""Caller-evidence analytics on Spark: from raw documents to evidence-backed knowledge about telephone numbers."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
