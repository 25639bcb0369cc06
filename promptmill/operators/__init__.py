"""DataFrame -> DataFrame operators over the pipeline's tables."""
