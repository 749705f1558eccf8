"""Adapters of the shared tables, contracts and diagrams."""
