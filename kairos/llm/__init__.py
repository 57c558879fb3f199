"""Operators for training-data pipelines: one module per operator, queries in ``queries.py``.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Code
that runs in Python workers is pickled by value, so executors need numpy,
pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
