"""Training-data operators: scoring, pseudonyms, licence rules, joins, search,
sharding, decontamination, URL rules and byte-level BPE.

Nothing else in the library imports this subpackage. Python functions of its
operators travel to the executors by value, so executors need only numpy,
pyarrow and regex, not a copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
