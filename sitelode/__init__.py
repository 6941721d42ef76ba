"""sitelode: search-readiness and search-result analytics on Spark.

Sub-packages
------------
functions   column expressions (urls, text, rounding)
sources     parsers that turn captured payloads into tables
operators   relational operators over those tables
plans       composed query plans exposed by ``__spark_entry__``
streaming   structured-streaming variants
"""

__version__ = "0.1.0"
