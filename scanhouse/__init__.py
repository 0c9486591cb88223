"""scanhouse: scan-report analytics on Spark.

Functions used inside Spark tasks (pandas UDFs, cogroup kernels) are pickled by
value, so executors run them without the package being installed on their Python
path (no ``--py-files`` needed).
"""

from pyspark import cloudpickle as _cloudpickle

import scanhouse as _self

_cloudpickle.register_pickle_by_value(_self)
