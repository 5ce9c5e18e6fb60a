"""skyloom: Spark-native catalog cleaning, graph analytics and corpus preparation.

Functions here are shipped to executors by value, so a job runs the same way whether or not
the executors have this repository on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
