"""Coded-image analytics and training-data operations as Spark jobs."""
