"""Siltstone: document search and analytics expressed as Spark plans."""
