"""Review-corpus analytics on Spark: ingest, resolve, screen, audit and report."""
