"""Spark jobs over tables of timed media records."""
