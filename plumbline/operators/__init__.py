"""Relational, graph, retrieval, ledger and causal operators."""
