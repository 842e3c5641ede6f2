"""Relational, bag, probe, conformal and metric operators."""
