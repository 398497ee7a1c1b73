"""Sentences of running text in the six languages of the corpus; shared by several operators."""

from __future__ import annotations

import re

#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("No", "Nr", "n", "e.g", "i.e", "approx", "ca", "z.B", "vgl", "Dr", "Mr", "Mrs", "St", "p.ex", "p.ej", "aprox", "env", "cf", "Art", "art", "Abs", "vs", "etc")

_end = re.compile(r"[.!?…]+[\"”’»)\]]*(?=\s|$)|[。！？]+[”’」』）]*|\n\s*")
_short = re.compile(r"(?:^|[\s(])(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")$")
_final = frozenset(".!?…。！？:：")
_mark = re.compile(r"[#*•–-] ?|\(?\d{1,3}[.)] |\(\d")
_next = re.compile(r"\s*[\"“«‘(¿¡\[]*([^\W\d_]?)")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence.

    A blank line always ends one, as does the end of a title; a single line end only after a closing mark or before a
    list mark, for lines may be filled; a point only before white space and no lower-case letter.
    """
    found, start = [], 0
    for m in _end.finditer(text):
        if text[m.start()] == ".":
            if _short.search(text, max(start, m.start() - 12), m.start()):
                continue
            after = _next.match(text, m.end())
            if after and after[1] and after[1].islower():
                continue
        end = m.end()
        if text[m.start()] == "\n":
            end = m.start()
            if m[0].count("\n") < 2 and not _closes(text, start, end, m.end()):
                continue
        if text[start:end].strip():
            found.append((start, end))
        start = m.end()
    if text[start:].strip():
        found.append((start, len(text)))
    return found


def _closes(text: str, start: int, end: int, after: int) -> bool:
    return text[start:end].rstrip()[-1:] in _final or text[start:end].lstrip().startswith("#") or bool(_mark.match(text, after))


def is_whole(sentence: str) -> bool:
    """Whether it ends as a sentence does; titles and list labels don't."""
    return sentence.rstrip().rstrip("\"”’»)]」』）*_`").endswith((".", "!", "?", "…", "。", "！", "？")) and not sentence.lstrip().startswith("#")
