"""Mailbox and task-list analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
