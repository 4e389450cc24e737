"""DNA-methylation array analytics on Spark DataFrames.

Every public function takes DataFrames and returns a DataFrame (or a fitted
``pyspark.ml`` model).  Measurements are kept long:
``sample_id string, probe_id string, value double``.
"""

import sys

from pyspark import cloudpickle

# Ship the code of Python functions to the executors with the tasks, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
