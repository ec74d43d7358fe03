"""Scalar, tuple and array operators as Column functions, with the language's errors."""

from .scalar import *  # noqa: F403
