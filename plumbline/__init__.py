"""Evidence engine on Spark: retrieval, verification and evaluation as DataFrame plans."""
