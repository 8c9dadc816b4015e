"""Query plans over the project's tables."""
