"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
