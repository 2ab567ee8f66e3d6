"""Parameters that arrive as text."""

from __future__ import annotations

import re


def parse_parameter(text: str) -> object:
    """``null``, booleans, integers and decimals by their look; everything else is a string."""
    lower = text.lower()
    if lower == "null":
        return None
    if lower in ("true", "false"):
        return lower == "true"
    if re.fullmatch(r"-?[0-9]+", text):
        if not -(2**63) <= int(text) < 2**63:
            raise ValueError(f"Integer out of range: {text}")
        return int(text)
    return float(text) if re.fullmatch(r"-?[0-9]+\.[0-9]+", text) else text
