"""Training-data operators: tokenising, quality, deduplication, sharding, chat format, decontamination, extraction.

One module per operator; ``queries.py`` registers them, ``oracles.py`` holds
the SQL where SQL can say the same. Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
