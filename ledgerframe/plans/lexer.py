"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<string>'(?:[^']|'')*')
      | (?P<op>[<>!=]=|<>|[<>!=])
      | (?P<symbol>[,()*;])
      | (?P<word>[^\s,()*;<>!=']+)
      | (?P<open>')""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def is_word(self, word: str) -> bool:
        return self.kind == "word" and self.text.upper() == word


def tokens(sql: str) -> list[Token]:
    """All tokens; ``-1`` and ``a-1`` are single words, quotes inside strings are doubled."""
    found = [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]
    if any(t.kind == "open" for t in found):
        raise ValueError("Unclosed string literal")
    return found
