"""pulsegrid: operational telemetry analytics written as ordinary PySpark.

Operators are plain functions ``DataFrame -> DataFrame`` or ``Column -> Column``
and chain with ``DataFrame.transform``.  Import them from the subpackages
``functions``, ``sources``, ``operators`` and ``streaming``.
"""

__version__ = "0.1.0"
