"""Planning data and training-data operators on Spark."""
