"""Operators for preparing training data; nothing else in the library imports them.

Functions that run on executors travel with their tasks, so that a cluster need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
