"""Operations of a training-data pipeline on documents and embeddings.

Functions that run inside tasks travel with the job by value, so executors need
nothing of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
