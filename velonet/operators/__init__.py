"""Relational, spatial and network operators."""
