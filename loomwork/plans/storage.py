"""Kept for callers: see loomwork.storage."""

from ..storage import cut_lineage, work_path

__all__ = ["cut_lineage", "work_path"]
