"""Auditing and running document extraction over large collections, as Spark jobs."""
