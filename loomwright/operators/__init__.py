"""Operators on columns of JSON documents."""

from .compress import Config, compress, decompress, estimate, shred
from .tables import grid_text, table_text

__all__ = ["Config", "compress", "decompress", "estimate", "grid_text", "shred", "table_text"]
