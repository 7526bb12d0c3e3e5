"""Query plans: hybrid search and what builds on it."""
