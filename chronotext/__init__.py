"""chronotext: text corpora observed over time, as lazy Spark plans."""
import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
