"""pageloom: retrieval pipelines over stored web pages, as Spark DataFrame operators.

The layers, lowest first:

* ``functions``  column expressions (URLs, HTML, text cleaning, parsing, vectors)
* ``sources``    scans and sinks
* ``operators``  DataFrame in, DataFrame out
* ``plans``      the multi-step jobs built from the operators
* ``streaming``  the incremental forms of the same jobs
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
