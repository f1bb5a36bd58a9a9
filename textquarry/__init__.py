"""textquarry: exact full-text search and text processing as Spark DataFrame plans.

Functions of this package that run in Python workers are pickled by value, so executors need not have the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
