"""skein: Spark-native complex-network and nonlinear time-series analytics."""

__version__ = "0.1.0"
