"""Whole documents read piece by piece from the bytes of a file: one object or some vertices at a time, never the parsed whole."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

_scan = json.JSONDecoder().scan_once
_SPACE = re.compile(r"[ \t\n\r]*")
_NAMED = re.compile(r'[ \t\n\r]*(?:,[ \t\n\r]*)?"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*')
_END = re.compile(r"\][ \t\n\r]*\]")
_BRACKETS = str.maketrans("", "", "[]")
#: Bytes of a gzip file that are read at once.
_STORED = 1 << 16


def texts(content: bytes, size: int = 1 << 20) -> Iterator[str]:
    """The text of a file, plain or gzip (of any number of members), in parts; the content is never copied whole."""
    decode, content = codecs.getincrementaldecoder("utf-8")().decode, memoryview(content).cast("B")
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), size):
            yield decode(content[i : i + size])
    else:
        gz = None
        for i in range(0, len(content), _STORED):
            left = content[i : i + _STORED]
            while left:
                if gz is None:
                    left = bytes(left).lstrip(b"\x00")
                    if not left:
                        break
                    gz = zlib.decompressobj(31)
                yield decode(gz.decompress(left, size))
                left, gz = (gz.unused_data, None) if gz.eof else (gz.unconsumed_tail, gz)
        while gz is not None and not gz.eof:
            part = gz.decompress(b"", size)
            if not part and not gz.eof:
                raise ValueError("the file ends inside its gzip stream")
            yield decode(part)
    yield decode(b"", True)


class Reader:
    """A place in a text that comes in parts; what lies before the place is forgotten."""

    def __init__(self, parts: Iterable[str]):
        self.parts, self.held, self.at = iter(parts), "", 0

    def more(self) -> bool:
        """At least doubles what is ahead, so that a long value is not scanned once a part; false at the end of the text."""
        ahead, new, size = self.held[self.at :], [], 0
        for part in self.parts:
            new.append(part)
            size += len(part)
            if size and size >= len(ahead):
                break
        self.held, self.at = "".join([ahead, *new]), 0
        return size > 0

    def peek(self) -> str:
        """The next character that is no space, or an empty text at the end."""
        while True:
            self.at = _SPACE.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise ValueError(f"no JSON: {char} is missing")
        self.at += 1

    def value(self):
        self.peek()
        while True:
            try:
                found, end = _scan(self.held, self.at)
                if end < len(self.held) or not self.more():  # a number may go on
                    self.at = end if end <= len(self.held) else len(self.held)
                    return found
            except (StopIteration, json.JSONDecodeError):
                if not self.more():
                    raise ValueError("no JSON: a value is missing or broken") from None

    def members(self) -> Iterator[tuple[str, object]]:
        """The members of an object one by one."""
        for name in self.names():
            yield name, self.value()

    def names(self) -> Iterator[str]:
        """The names of an object's members; the caller reads each value before it asks for the next name."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            if self.peek() != '"':
                raise ValueError("no JSON: a name is missing")
            name = self.value()
            self.take(":")
            yield name
            if self.peek() == "}":
                self.at += 1
                return
            self.take(",")

    def objects(self) -> Iterator[tuple[str, object]]:
        """As ``members``, with a short way for names without escapes."""
        self.take("{")
        first = True
        while True:
            m = _NAMED.match(self.held, self.at)
            if m and (self.held[self.at : m.start(1)].count(",") == 0) == first:
                try:
                    found, end = _scan(self.held, m.end())
                    if end < len(self.held):
                        self.at, first = end, False
                        yield m[1], found
                        continue
                except (StopIteration, json.JSONDecodeError):
                    pass
            if (c := self.peek()) == "}":
                self.at += 1
                return
            if not first:
                self.take(",")
                c = self.peek()
            if c != '"':
                raise ValueError("no JSON: a name is missing")
            name = self.value()
            self.take(":")
            first = False
            yield name, self.value()

    def triples(self) -> np.ndarray:
        """A list of lists of three whole numbers, as (n, 3)."""
        return np.concatenate([np.zeros((0, 3), np.int64), *self.triple_parts()])

    def triple_parts(self) -> Iterator[np.ndarray]:
        """As ``triples``, some rows at a time."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            end = _END.search(self.held, self.at)
            stop = end.start() + 1 if end else self.held.rfind("]", self.at) + 1
            if stop > self.at:
                text = self.held[self.at : stop].lstrip(" \t\n\r,")
                if text:
                    yield _numbers(text)
                self.at = stop
            if end:
                self.at = end.end()
                return
            if not self.more():
                raise ValueError("no JSON: the vertices have no end")


def _numbers(text: str) -> np.ndarray:
    n, bare = text.count("["), text.translate(_BRACKETS)
    try:
        found = np.array([int(x) for x in bare.split(",")], np.int64) if n < 64 else np.fromstring(bare, np.int64, sep=",")
    except (ValueError, OverflowError, DeprecationWarning):
        found = ()
    if len(found) != 3 * n:
        raise ValueError("vertices are not of three whole numbers")
    return found.reshape(-1, 3)
