"""Relational, graph, lifecycle and text operators."""
