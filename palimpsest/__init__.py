"""Fleet-scale memorization audits as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing here holds
data on the driver. ``operators`` has the relational work, ``functions`` the
Column expressions, ``sources`` the scans and sinks, ``streaming`` the live
jobs and ``plans`` the end-to-end jobs and the registered queries.
"""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with each task, so executors need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
