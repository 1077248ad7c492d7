"""Table contracts, readers and writers."""
