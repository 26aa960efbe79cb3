"""Imports every query module so that the registry is complete."""

from . import q_analytics, q_board, q_io, q_layouts, q_matches, q_puzzles, q_rollups, q_scoring, q_streaming  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
