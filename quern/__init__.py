"""quern: large-scale data mining operators expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
