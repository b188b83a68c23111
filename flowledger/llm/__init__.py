"""Training-data operators: one module each, with their queries in ``queries``.

Nothing else in the package imports this folder.  Functions that run on
executors are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
