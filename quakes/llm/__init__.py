"""Training-data operators.  Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions sent to workers travel whole: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
