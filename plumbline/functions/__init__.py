"""Column helpers shared by all operators. Everything here stays inside the JVM."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
