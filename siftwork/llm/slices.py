"""Cutting long texts where no tokenizer of the given kinds joins across the cut.

A cut lies before a single space that stands between two characters that are not white space
("x| y"). A byte-level BPE pre-tokenizer starts a new word at that space, and a
SentencePiece vocabulary without an inner space in any piece never merges over it, so the ids of
a text are the ids of its slices in a row.
"""

from __future__ import annotations

import re

_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut_before(text: str, at: int) -> int:
    """The last cut at or before ``at``; 0 when there is none."""
    end = at
    while end > 0:
        begin = max(0, end - 4096)
        found = 0
        for m in _CUT.finditer(text, max(0, begin - 1), min(len(text), end + 2)):
            if m.start() <= end:
                found = m.start()
        if found > 0:
            return found
        end = begin
    return 0


def cut_after(text: str, at: int) -> int:
    """The first cut at or after ``at``; the text's length when there is none."""
    m = _CUT.search(text, at)
    return m.start() if m else len(text)


def slices(text: str, size: int = 1 << 16) -> list[str]:
    """The text in slices of about ``size`` characters (more where no cut is near)."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = cut_after(text, at + size) if at + size < len(text) else len(text)
        out.append(text[at:end])
        at = end
    return out
