"""quernstone: a PySpark-native engine for evidence retrieval and corpus preparation."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel whole: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
