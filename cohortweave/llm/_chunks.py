"""Cut a text where a byte-level BPE's split pattern always cuts.

The split pattern of the rank files never joins anything across white space,
but for one space before a run without white space.  So the pieces below can be
encoded alone, and what they encode to can be remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

# The code points with the Unicode property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
GROUP_CHARS = 1 << 19
#: Longer pieces are not remembered.
_LONGEST = 64


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive texts (null: empty), about ``GROUP_CHARS`` characters at a time; long ones stand alone."""
    held: list[str] = []
    n = 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= GROUP_CHARS or len(held) >= 2048:
            yield held
            held, n = [], 0
    if held:
        yield held


class Memory(dict):
    """Remembered results (strings or bytes) of short strings, in two generations of at most about ``limit`` bytes each."""

    def __init__(self, compute, limit: int) -> None:  # noqa: ANN001
        super().__init__()
        self.compute, self.limit, self.used = compute, limit, 0
        self.older: dict = {}

    def __missing__(self, key: str):  # noqa: ANN204
        got = self.older.get(key)
        if got is None:
            got = self.compute(key)
        if len(key) <= _LONGEST:
            if self.used > self.limit:
                self.older, self.used = dict(self), 0
                self.clear()
            self[key] = got
            self.used += 200 + len(key) + len(got)
        return got
