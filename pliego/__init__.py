"""Document retrieval as Spark jobs: ingest, search, context assembly and conversation state."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
