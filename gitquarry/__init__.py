"""gitquarry: software-repository mining as Spark DataFrame operators.

Every public operator is a deterministic function from DataFrames to a
DataFrame.  Only scalars and fitted parameters reach the driver; the
session is always passed in by the caller.
"""

from gitquarry.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are pickled with their
# code, so that a cluster whose workers lack the package can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
