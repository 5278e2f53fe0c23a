"""Track and event analytics as PySpark DataFrame functions.

Every operator takes and returns DataFrames keyed by ``source_id`` (one video
or live session) and, where objects are told apart, ``stable_id``.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so no
# executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
