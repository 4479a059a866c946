"""Floor-plan analytics on Spark. Python kernels travel to the workers with the job, so these need no installed package."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
