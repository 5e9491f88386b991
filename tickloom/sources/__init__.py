"""Reading profile files, profile records and stored tables."""
