"""Triage of free-text inspection findings as plain Spark jobs.

Every public function takes and returns a ``DataFrame`` or a ``Column``.
"""

import sys

from pyspark import cloudpickle

# Python workers receive our small vector helpers by value, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
