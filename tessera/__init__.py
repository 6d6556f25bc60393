"""Tessera: retrieval analytics and corpus processing expressed as Spark plans."""
