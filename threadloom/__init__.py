"""threadloom: conversation analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so that executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
