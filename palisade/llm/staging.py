"""Intermediate tables of the corpus operators: those of the library."""

from ..staging import fresh_path, shared_dir, stage

__all__ = ["fresh_path", "shared_dir", "stage"]
