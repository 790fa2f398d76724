"""Relational, retrieval, graph, lifecycle and evaluation operators."""
