"""Rating prediction and recommendation as Spark jobs on DataFrames."""

import sys

from pyspark import cloudpickle

from starfold.session import build_session, shared_folder

# Functions of this package travel inside the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_folder"]
