"""Operators for preparing large text and vector collections; nothing else imports this package."""

import sys

from pyspark import cloudpickle

# Workers get the functions of these modules with the task, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
