"""What the operators share: tables, the shared folder, and the hash that tells rows of one doc_id apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import run_folder, settle, shared_folder, table

__all__ = ["row_hash", "run_folder", "settle", "shared_folder", "table"]


def row_hash(text) -> F.Column:
    """Tells apart rows that share a doc_id; a null text is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
