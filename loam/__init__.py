"""loam: retrieval, temporal-graph and quality analytics on Spark, with the operations of a training-data pipeline."""
