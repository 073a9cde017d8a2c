"""DataFrame operators for documentation corpora on Spark."""
