"""Cutting texts where byte-level BPE cannot merge, so that each distinct piece is encoded once.

A unit is an optional blank with the non-blank run behind it, or a run of white space. Pre-tokens of the
byte-level pattern never cross a unit's border, so the ids of a text are those of its units in order.
"""

from __future__ import annotations

import re

# The characters with the Unicode property White_Space.
BLANKS = r"\t-\r \x85\xa0  -     　"
UNIT = re.compile(rf" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
# Longer units are encoded as they come: they hardly recur, and the cache must stay small.
LONGEST_KEPT = 64


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def split_specials(specials: list[str]):
    """A function from a text to (part, is_special) pairs, longest special string first, as the library scans."""
    if not specials:
        return lambda text: [(text, False)]
    pattern = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))

    def parts(text: str) -> list[tuple[str, bool]]:
        out, at = [], 0
        for m in pattern.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m[0], True))
            at = m.end()
        if at < len(text):
            out.append((text[at:], False))
        return out

    return parts
