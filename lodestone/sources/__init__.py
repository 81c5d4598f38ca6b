"""Readers and writers of archives, artifacts and small tables."""
