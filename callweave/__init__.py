"""Call-graph comparison and training-data operators on Spark."""
