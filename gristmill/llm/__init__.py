"""Operators for large training-text corpora: cleaning, deduplication, decontamination, mixing, sharding.

Functions that run on executors are shipped by value, so that a cluster needs no copy of this
package on its worker machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["gristmill"])
