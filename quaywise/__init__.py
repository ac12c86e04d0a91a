"""quaywise: demand analytics and training-data operations as Spark jobs."""
