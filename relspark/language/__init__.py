"""The text front end: statements and expressions of the relational language."""

from .interpreter import Session
from .syntax import parse_expression, parse_script

__all__ = ["Session", "parse_expression", "parse_script"]
