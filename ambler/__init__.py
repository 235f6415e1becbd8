"""Graph sampling and random walks as Spark DataFrame plans."""
