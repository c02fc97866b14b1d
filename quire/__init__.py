"""Document-layout analytics on Spark: DataFrame operators over positioned text blocks and their catalog."""
