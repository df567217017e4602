"""loghaven: a Spark-native warehouse for blockchain event logs."""

__version__ = "0.1.0"
