"""Training-data operators: ten Spark jobs that nothing else in the library imports."""
