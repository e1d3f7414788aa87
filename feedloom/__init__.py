"""Customer-feedback analytics on Spark.

Every public function takes and returns DataFrames (or Columns) and runs nothing by itself;
the few that write say so in their docstring.
"""

import sys

from pyspark import cloudpickle

# the little Python that runs on executors travels with the job: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
