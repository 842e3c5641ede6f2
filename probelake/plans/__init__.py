"""probelake plans."""
