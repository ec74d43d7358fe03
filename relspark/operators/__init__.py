"""Relational operators."""

from .aggregates import ALL, ANY, AVG, COUNT, MAX, MIN, SUM, Aggregate, Nested
from .relation import Relation, dee, dum, relation

__all__ = ["ALL", "ANY", "AVG", "COUNT", "MAX", "MIN", "SUM", "Aggregate", "Nested", "Relation", "dee", "dum", "relation"]
