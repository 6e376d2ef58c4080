"""Trip analytics on Spark DataFrames: operators, sources and six end-to-end jobs.

Functions that run in Python workers travel by value: a job works with the package on the driver's
path alone, without ``--py-files``.
"""

import sys

from pyspark import cloudpickle

from tripflow.params import TripWindow

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["TripWindow"]
