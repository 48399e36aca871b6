"""recurra: adaptive stream analytics expressed as Spark DataFrame plans."""
