"""Operators of a training-data pipeline; nothing else in the package imports them.

What runs in Python workers is sent to them with the job, so that a cluster needs no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
