"""siftmesh: Spark-native web-document search, link analytics and corpus operators."""

__version__ = "0.1.0"
