"""Lenient reading of JSON payloads: one whole JSON value or nothing, at any depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_GAP = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str):
    raise ValueError(name)


def _scalar(text: str, at: int):
    """(value, end) of the scalar at a place."""
    if text.startswith('"', at):
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(at)
    whole, fraction, power = m.groups()
    return (float(m.group()) if fraction or power else int(whole)), m.end()


def _deep(text: str):
    """The value of a text nested too deeply for the recursive reader; open containers are kept on a stack."""
    gap = lambda i: _GAP.match(text, i).end()
    root: list = []
    stack: list[list | dict] = [root]
    name, at = None, gap(0)
    while True:
        # A value is due at ``at``.
        if text[at : at + 1] in ("{", "["):
            value: object = {} if text[at] == "{" else []
            at = gap(at + 1)
        else:
            value, at = _scalar(text, at)
        if isinstance(stack[-1], dict):
            stack[-1][name] = value
        else:
            stack[-1].append(value)
        opened = isinstance(value, (dict, list))
        if opened:
            stack.append(value)
        while len(stack) > 1:
            at = gap(at)
            end = "}" if isinstance(stack[-1], dict) else "]"
            if text[at : at + 1] == end and (opened or at):
                stack.pop()
                at, opened = at + 1, False
                continue
            if not opened:
                if text[at : at + 1] != ",":
                    raise ValueError(at)
                at = gap(at + 1)
            if isinstance(stack[-1], dict):
                if text[at : at + 1] != '"':
                    raise ValueError(at)
                name, at = scanstring(text, at + 1, True)
                at = gap(at)
                if text[at : at + 1] != ":":
                    raise ValueError(at)
                at = gap(at + 1)
            break
        if len(stack) == 1:
            if gap(at) != len(text):
                raise ValueError(at)
            return root[0]


#: Escapes one by one: a surrogate pair, half of one, any other.
_ESCAPE = re.compile(r"\\(?:(u[dD][89abAB]\w\w\\u[dD][c-fC-F]\w\w)|(u[dD][89a-fA-F]\w\w)|.)", re.S)
_HALVES = re.compile(r"\\u[dD][89a-fA-F]")


def whole_value(text: str | None, *, halves: bool = False):
    """(True, value) when ``text`` is exactly one JSON value (RFC 8259), else (False, None).

    A byte order mark before the value is ignored. ``NaN`` and ``Infinity`` are no JSON. Of repeated
    members the last counts. Nesting is bounded by memory alone. Half of a surrogate pair, which no
    column can hold, becomes U+FFFD unless ``halves`` are asked for.
    """
    if text is None:
        return False, None
    text = text.lstrip("\ufeff")
    if not halves and _HALVES.search(text):
        text = _ESCAPE.sub(lambda m: "\\ufffd" if m.group(2) else m.group(), text)
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _deep(text)
    except ValueError:
        return False, None
