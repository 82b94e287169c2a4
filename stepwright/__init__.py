"""stepwright: a PySpark engine for building and analysing multi-step retrieval datasets.

Python functions that run on executors are shipped by value, so that workers
need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
