"""Training-data operators: extraction, language, quality, duplicates, mixing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the folder is there.
"""

import sys

from pyspark.cloudpickle import cloudpickle

# functions go to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
