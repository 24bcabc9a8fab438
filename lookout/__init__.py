"""Log supervision analytics on Spark.

Functions that run in Python workers (pandas / Arrow UDFs) are pickled by
value, so executors need neither this package on their path nor a shipped zip.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
