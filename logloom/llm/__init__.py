"""Operators for large training-text pipelines.

Nothing outside this package imports it.  Functions of this package that run
in Python workers are pickled by value, so a job does not depend on the
package being installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
