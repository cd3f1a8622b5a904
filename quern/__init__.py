"""quern: queries and data processing over snapshot-based tables, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions that run in Python workers travel with the query, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
