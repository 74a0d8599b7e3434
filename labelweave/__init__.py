"""labelweave: Spark-native analytics for nested, multi-labelled document corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole with the job, so the
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
