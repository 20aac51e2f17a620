"""Operators for preparing training text at scale.

Thirteen operators, one module each, plus :mod:`runtime` (shared-folder tables,
text hashing) and :mod:`graph` (connected components).  Nothing outside this
subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that executors need no
# copy of this repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
