"""Statements of a query history as they are compared."""

from __future__ import annotations

import re


def normalise(statement: str | None) -> str:
    return re.sub(r"\s+", " ", (statement or "").strip())
