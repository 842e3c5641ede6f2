"""probelake sources."""
