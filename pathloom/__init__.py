"""Road-network analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that no worker needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
