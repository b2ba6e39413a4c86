"""tessera — a Spark-native tabular data-science engine.

Operators are plain functions from DataFrame to DataFrame.  Heavy work runs
as Spark aggregations, joins, windows or MLlib fits; only small per-column
or per-group statistics ever reach the driver.
"""

__version__ = "0.1.0"
