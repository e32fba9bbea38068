"""Plain SQL for the catalogue, written from the closed forms of the synthetic network."""

from oracles.sql import ORACLES

__all__ = ["ORACLES"]
