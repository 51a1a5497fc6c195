"""Market analytics as Spark jobs: bars, indicators, pairs, portfolios and streams.

The package is pickled by value, so tasks need no copy of it on the executors' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
