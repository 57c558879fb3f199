"""kairos: point-in-time features and survival analytics on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark built-ins. Sub-packages:

* ``sources``   - readers, writers and the fixture views over the driver tables
* ``functions`` - column expressions (dates, bins, text clean-up, curves)
* ``operators`` - the relational and statistical operators
* ``plans``     - named queries (Spark and DuckDB text) and pipelines
* ``streaming`` - micro-batch wrapper for the point-in-time features
"""

__version__ = "0.1.0"
