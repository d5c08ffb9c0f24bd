"""Operators for preparing training corpora; nothing else in the library imports this folder.

Functions that run in tasks are sent to the executors whole, so the executors
need Python and the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
