"""riskfeatures — Spark-native point-in-time risk analytics on work-item data.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL primitives; nothing here collects data to the driver.
"""

__version__ = "0.1.0"
