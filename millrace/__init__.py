"""millrace: corpus and evaluation analytics expressed as Spark plans."""
