"""Registered queries of the core library: one per operator of the inventory, with their SQL."""

from __future__ import annotations

from .registry import ORACLES, QUERIES  # noqa: F401
from . import corpus, evaluation, exports, extension, inspection, landmarks, relational, retrieval  # noqa: E402, F401
