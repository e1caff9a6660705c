"""tessera: a Spark-native engine for code and text corpora and for the ledgers of the pipelines that process them."""

__version__ = "0.1.0"
