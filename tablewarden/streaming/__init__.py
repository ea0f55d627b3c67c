"""Contracts over micro-batches, and counts that ride on a write."""

from .batches import check_batches, check_on_write

__all__ = ["check_batches", "check_on_write"]
