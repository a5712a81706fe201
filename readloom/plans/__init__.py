"""Registered queries of the operators, over fixtures derived from the test tables."""

from . import q_assign, q_counting, q_formats, q_front, q_fusion, q_more, q_regions, q_rest
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_assign", "q_counting", "q_formats", "q_front", "q_fusion", "q_more", "q_regions", "q_rest"]
