"""tessera: a Spark-native engine for tabular analytics and modelling.

Every operator is a function ``DataFrame -> DataFrame`` (or a small driver-side
helper over a schema) built on the public DataFrame, SQL and ML APIs, so that
Catalyst plans the work and the same code runs on one laptop or a cluster.
"""

__version__ = "0.1.0"
