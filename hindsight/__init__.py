"""Entity-conditioned event analytics expressed as Spark DataFrame plans."""
