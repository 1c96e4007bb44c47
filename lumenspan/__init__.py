"""Spark-native analytics over LLM and agent telemetry.

Functions that run on executors are pickled by value, so that workers need no
copy of the package, wherever the driver was started.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
