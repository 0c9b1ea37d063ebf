"""plenum: transcript, knowledge-graph and corpus analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
