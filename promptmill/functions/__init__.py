"""Column builders. Nothing here starts a Spark job."""
