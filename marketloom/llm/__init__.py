"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Functions for Python workers travel with their tasks, so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
