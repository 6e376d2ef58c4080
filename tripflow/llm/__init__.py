"""Operators for building training corpora. Nothing else in the package imports this folder.

Their functions travel to the workers by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
