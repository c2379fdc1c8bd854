"""JSON documents that hold an array: the text of each element, whatever it is."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_SPACE = re.compile(r"[ \t\r\n]*")
#: A string, a bracket or a comma; anything else cannot end an element.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]', re.DOTALL)


def array_elements(text: str) -> Iterator[str]:
    """The elements of the array that ``text`` holds, each as it is written.

    An element that is not JSON is given up to the comma or bracket that ends it. What is
    left of a document that breaks off, or that goes on after its array, is one element, and
    so is a document that is no array. A blank document has none.
    """
    decoder = json.JSONDecoder()
    at = _after_space(text, 1 if text.startswith("\ufeff") else 0)
    if at == len(text):
        return
    if text[at] != "[":
        yield text[at:].rstrip(" \t\r\n")
        return
    at = _after_space(text, at + 1)
    if text[at : at + 1] == "]":  # an empty array
        yield from _rest(text, at + 1)
        return
    while at < len(text):
        try:
            end = decoder.raw_decode(text, at)[1]
        except (json.JSONDecodeError, RecursionError):
            end = at
        after = _after_space(text, end)
        if end == at or text[after : after + 1] not in (",", "]"):
            end = after = _end_of_broken(text, at)
            if end is None:
                break
        if end > at:  # two commas in a row have nothing between them
            yield text[at:end].rstrip(" \t\r\n")
        at = _after_space(text, after + 1)
        if text[after] == "]":
            break
    yield from _rest(text, at)


def _rest(text: str, at: int) -> Iterator[str]:
    left = text[at:].strip(" \t\r\n")
    if left:
        yield left


def _after_space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _end_of_broken(text: str, at: int) -> int | None:
    """Where the comma or bracket is that ends the element at ``at``; none if the document ends first."""
    depth = 0
    for mark in _MARK.finditer(text, at):
        sign = mark[0]
        if depth == 0 and sign in ",]":
            return mark.start()
        depth = max(0, depth + (sign in "[{") - (sign in "]}"))
    return None
