"""Readers: files of all supported formats as frames, with text cells where the format has no types."""

from .options import ReadOptions, SourceError
from .readers import Source, jdbc_source, open_source, table_source

__all__ = ["ReadOptions", "Source", "SourceError", "jdbc_source", "open_source", "table_source"]
