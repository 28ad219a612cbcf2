"""Training-log and text-retrieval analytics expressed as Spark DataFrame jobs."""
