"""Lodestone: retrieval, code-migration scanning and corpus checks as Spark DataFrame plans."""
