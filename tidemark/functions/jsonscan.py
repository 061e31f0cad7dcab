"""One pass over JSON text as a stream of tokens: no tree is built, depth costs a list entry, and text that breaks off is read as far as it goes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator

_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("[^"\\]*(?:\\.[^"\\]*)*")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null))', re.S)
_REST = re.compile(r"[ \t\r\n]*")


class Event:
    """A value: the key that it stands under (None in arrays and at the top), its kind (`{`, `[`, `"` or `0` for other scalars), its span and the depth of what holds it. A container has the end of its opening sign until it is closed; `closes` tells its events apart."""

    __slots__ = ("key", "kind", "start", "end", "depth", "closes")

    def __init__(self, key: str | None, kind: str, start: int, end: int, depth: int, closes: bool = False):
        self.key, self.kind, self.start, self.end, self.depth, self.closes = key, kind, start, end, depth, closes


class Scan:
    """The events of a text in document order; after they are read, `end` is where reading stopped and `whole` tells whether the text is one whole JSON value."""

    def __init__(self, text: str):
        self.text, self.end, self.whole = text, 0, False

    def __iter__(self) -> Iterator[Event]:
        text, at, held = self.text, 0, []  # held: (sign, key, start) of each open container
        key, want = None, "value"  # value, first (value or end of array), key, firstkey (or end of object), colon, next (comma or end)
        while True:
            token = _TOKEN.match(text, at)
            if not token or (want == "next" and not held):
                break
            sign, string, start = token[1], token[2], token.end() - len(token[1] or token[2] or token[3])
            if want in ("value", "first") and (string or token[3] or sign in ("{", "[")):
                yield Event(key, sign or ('"' if string else "0"), start, token.end(), len(held))
                if sign:
                    held.append((sign, key, start))
                    want = "firstkey" if sign == "{" else "first"
                else:
                    want = "next"
                key = None
            elif want in ("key", "firstkey") and string:
                key, want = _text_of(string), "colon"
            elif want == "colon" and sign == ":":
                want = "value"
            elif want == "next" and sign == ",":
                want = "key" if held[-1][0] == "{" else "value"
            elif want in ("next", "first", "firstkey") and sign in ("}", "]") and (held[-1][0] == "{") == (sign == "}") and not (want == "first" and sign == "}"):
                opened, own, start = held.pop()
                yield Event(own, opened, start, token.end(), len(held), closes=True)
                want = "next"
            else:
                break
            at = self.end = token.end()
        self.key = key if want == "value" else None  # the key whose value is missing or broken off
        self.whole = want == "next" and not held and _REST.fullmatch(text, at) is not None


def _text_of(string: str) -> str:
    try:
        return json.loads(string, strict=False)
    except ValueError:
        return string[1:-1]


def value_text(text: str, event: Event) -> str:
    return _text_of(text[event.start : event.end]) if event.kind == '"' else text[event.start : event.end]


def redact(text: str, keys: Collection[str], by: str, leaf: Callable[[str], str]) -> str:
    """The text with every value under one of the keys (lower case) replaced, and every other string run through `leaf`; all else stays as it is written.

    A value that breaks off under such a key is replaced to the end of the text. What is not
    one whole JSON value is run through `leaf` once more, as a whole.
    """
    out, copied, hidden = [], 0, None  # hidden: depth of the container that is being left out
    scan = Scan(text)
    for event in scan:
        if hidden is not None:
            if event.closes and event.depth == hidden:
                copied, hidden = event.end, None
            continue
        if event.closes:
            continue
        if event.key is not None and event.key.lower() in keys:
            out += [text[copied : event.start], json.dumps(by)]
            copied, hidden = event.end, event.depth if event.kind in "{[" else None
        elif event.kind == '"':
            plain = value_text(text, event)
            if (safe := leaf(plain)) != plain:
                out += [text[copied : event.start], json.dumps(safe, ensure_ascii=False)]
                copied = event.end
    if hidden is None:
        if scan.key is not None and scan.key.lower() in keys and _REST.fullmatch(text, scan.end) is None:
            out += [text[copied : scan.end], json.dumps(by)]
        else:
            out.append(text[copied:])
    told = "".join(out)
    return told if scan.whole else leaf(told)


def find(text: str, key: str) -> str | None:
    """The first value under a key (any case) in document order: a string, number or boolean as text, an object by its own `name` if that is a string. What is none of these is searched inside; null is passed over."""
    named: list[int] = []  # depths of objects under the key that are open
    for event in Scan(text):
        if event.closes:
            if named and event.depth == named[-1]:
                named.pop()
            continue
        if event.key is None:
            continue
        if named and event.key == "name" and event.kind == '"' and event.depth == named[-1] + 1:
            return value_text(text, event)
        if event.key.lower() == key.lower():
            if event.kind == "{":
                named.append(event.depth)
            elif event.kind == '"' or event.kind == "0" and text[event.start : event.end] != "null":
                return value_text(text, event)
    return None
