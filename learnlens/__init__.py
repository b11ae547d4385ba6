"""Learning analytics over question-attempt tables, written as Spark DataFrame jobs."""
