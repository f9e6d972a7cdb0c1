"""Registered queries: importing any module here registers all."""

from .queries import ORACLES, QUERIES  # noqa: F401, I001
from . import field, capture, checks, deliveries, learning, places, sensing, study  # noqa: F401
