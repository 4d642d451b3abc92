"""Evidence-event analytics on Spark.

Client log text is framed into lines, assembled into records, matched against versioned rule tables and turned into
typed, validated, de-duplicated events. Correlation, projections, feeds, governance and export build on that event
table. Everything is DataFrame in, DataFrame out.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
