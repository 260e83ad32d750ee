"""Cutting a text at places that no byte-level BPE pre-token can cross.

A pre-token of the byte-level pattern holds a space only as its first
character or inside a run of white space. So a space that follows a
character other than white space always starts a new pre-token, and the
text may be cut before it. The segments ("word," with its blank) are far
fewer than the pre-tokens are, repeat a lot, and are what workers cache.
"""

from __future__ import annotations

import re

# white space as Python sees it holds every character that the tokenizers'
# patterns call white space; where Python sees more, the text is only cut less
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def blank_words(text: str) -> tuple[str, list[str]]:
    """(head, words): ``text == head + "".join(" " + w for w in words)``,
    where the text may be cut before each of these blanks."""
    if not text.startswith(" ") and not _SPACE_AFTER_SPACE.search(text):
        head, *words = text.split(" ")
        return head, words
    parts = _BEFORE_SPACE.split(text)
    if parts[0].startswith(" "):
        return "", [p[1:] for p in parts]
    return parts[0], [p[1:] for p in parts[1:]]
