"""textloom: text and document analytics expressed as Spark DataFrame jobs."""
