"""Key/value dataflows on Spark: read text as ``(key, value)``, map, shuffle, reduce, write."""

import sys

from pyspark import cloudpickle

# Ship the package's functions inside each task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
