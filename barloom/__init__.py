"""barloom: market-bar and trade analytics expressed as Spark DataFrame plans."""
