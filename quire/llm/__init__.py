"""Training-data operators; nothing else in the library imports this subpackage.

Its classes and functions are pickled by value, so executors need no copy of
the package: the functions that run there import only numpy, pyarrow and the
tokenizer libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
