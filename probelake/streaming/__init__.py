"""probelake streaming."""
