"""Importing the query modules fills the registry."""
from . import accuracy, files, motion, people, pitch, tactics  # noqa: F401
from .registry import ORACLES, QUERIES, oracles  # noqa: F401
