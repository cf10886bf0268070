"""Registered queries and their SQL; importing the modules fills the catalog."""

from . import corpus, expression, instances, report, scores, sources, spatial, tiles
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "corpus", "expression", "instances", "report", "scores", "sources", "spatial", "tiles"]
