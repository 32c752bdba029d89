"""Table and event readers, writers and the canonical views over the supplied tables."""
