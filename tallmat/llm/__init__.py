"""Operators for preparing training data.

Nothing outside this folder imports it. Functions that run in Python workers are shipped with the job.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
