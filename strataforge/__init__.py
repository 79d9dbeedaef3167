"""strataforge: artifact analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so no file has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
