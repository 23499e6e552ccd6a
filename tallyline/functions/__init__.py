import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions and classes of this package travel to the workers whole, so that they need not have it installed
register_pickle_by_value(sys.modules[__name__])
