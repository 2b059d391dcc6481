"""Importing this package registers every query."""

from tabloom.plans import clean, events, io, learn, rollups, series, stats, text  # noqa: F401
from tabloom.plans.registry import ORACLES, QUERIES  # noqa: F401
