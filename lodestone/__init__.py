"""Lodestone: hybrid document retrieval over linked knowledge bases, written as Spark DataFrame jobs."""
