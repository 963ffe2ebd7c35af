"""Training-data operators. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import tidelog.llm as _self

# Functions of this subpackage travel to the executors by value, so that a cluster
# whose workers lack the package runs them too.
cloudpickle.register_pickle_by_value(_self)
