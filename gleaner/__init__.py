"""Evidence retrieval over collections of text, expressed as Spark relations keyed by query."""
