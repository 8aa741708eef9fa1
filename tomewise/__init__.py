"""Book-recommendation analytics as Spark jobs over all users at once."""
