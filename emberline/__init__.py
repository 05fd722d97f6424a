"""Point-in-time trend analytics expressed as Spark DataFrame plans."""
