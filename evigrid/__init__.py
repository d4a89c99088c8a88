"""Place-based evidence analytics expressed as Spark DataFrame plans."""
