"""Compositions of operators: the reference's stages as Spark plans."""
