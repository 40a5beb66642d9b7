"""chronoloom: annotated time-series datasets as ordinary Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with the job, so nothing needs to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
