from . import balances, datasets, embeddings, evaluation, labels, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
