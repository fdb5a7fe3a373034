"""From source exports to the six landing tables, and from results to files."""
