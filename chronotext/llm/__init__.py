"""Operators of a training-data pipeline.  Nothing else in the library imports this package."""
import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
