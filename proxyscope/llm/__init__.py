"""Operations for preparing language-model training data.

Functions of this subpackage that run in tasks are sent by value, so executors need not
have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
