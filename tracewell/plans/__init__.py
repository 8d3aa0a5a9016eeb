"""Job plumbing: shared-folder staging of intermediate tables."""
