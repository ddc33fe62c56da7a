"""quern: classical information retrieval as Spark DataFrame algebra."""
