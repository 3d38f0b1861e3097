"""rostrum: analytics for recorded talks and text corpora, written as Spark DataFrame jobs."""
