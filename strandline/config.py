"""Limits by environment: STRANDLINE_DEFAULT_LIMIT, STRANDLINE_MAX_DEPTH, STRANDLINE_MAX_FILE_BYTES."""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass

# Default, least and largest value.
DEFAULT_LIMIT = (50, 1, 5000)
MAX_DEPTH = (10, 1, 100)
MAX_FILE_BYTES = (1_000_000, 1, 1 << 40)


@dataclass(frozen=True)
class Limits:
    default_limit: int
    max_depth: int
    max_file_bytes: int


def number(env: Mapping[str, str], name: str, bounds: tuple[int, int, int]) -> int:
    """A whole number within bounds; what is not one, or lies outside, is said on standard error and put right."""
    default, low, high = bounds
    raw = env.get(name, "").strip()
    if not raw:
        return default
    try:
        value = int(float(raw))
    except (ValueError, OverflowError):
        print(f"{name}={raw!r} is no number; {default} is taken", file=sys.stderr)
        return default
    held = min(high, max(low, value))
    if held != value:
        print(f"{name}={raw!r} is not between {low} and {high}; {held} is taken", file=sys.stderr)
    return held


def limits(env: Mapping[str, str] = os.environ) -> Limits:
    return Limits(number(env, "STRANDLINE_DEFAULT_LIMIT", DEFAULT_LIMIT), number(env, "STRANDLINE_MAX_DEPTH", MAX_DEPTH), number(env, "STRANDLINE_MAX_FILE_BYTES", MAX_FILE_BYTES))
