"""DataFrame operators for visual-inspection data."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
