"""Tokens of JavaScript and TypeScript source: as much as declarations and test suites need."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass


class SourceError(ValueError):
    """The source cannot be read, or not without ambiguity."""


@dataclass(frozen=True)
class Token:
    kind: str  # id, str, tpl, num, re, private, punct
    text: str
    start: int
    end: int

    @property
    def value(self) -> str:
        """What a string literal says."""
        if self.kind != "str":
            return self.text
        body = self.text[1:-1]
        if "\\" not in body:
            return body
        body = re.sub(r"\\\r?\n", "", body)
        body = re.sub(r"\\x([0-9A-Fa-f]{2})", r"\\u00\1", body)
        body = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), body)
        body = re.sub(r"\\([^bfnrtu\\/\"])", r"\1", body)
        return json.loads('"' + re.sub(r'(?<!\\)"', r"\\\"", body) + '"', strict=False)


_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\ufeff)+", re.S)
_WORD = re.compile(r"[\w$\u200c\u200d]+")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.|\\\r\n)*'|\"(?:[^\"\\\n]|\\.|\\\r\n)*\"", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.|\?\?=?|&&=?|\|\|=?|[=!]==?|[-+*/%&|^]=|\+\+|--|.", re.S)
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


def _template_end(source: str, at: int) -> int:
    """Where a template literal that opens at `at` ends."""
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            for token in _scan(source, at):
                depth += {"{": 1, "}": -1}.get(token.text, 0) if token.kind == "punct" else 0
                at = token.end
                if not depth:
                    break
            else:
                break
        else:
            at += 1
    raise SourceError("a template literal does not end")


def _scan(source: str, at: int):
    last = None
    while True:
        if skip := _SKIP.match(source, at):
            at = skip.end()
        if at >= len(source):
            return
        c = source[at]
        if c in "'\"":
            found = _STRING.match(source, at)
            if not found:
                raise SourceError(f"a string does not end (offset {at})")
            kind, end = "str", found.end()
        elif c == "`":
            kind, end = "tpl", _template_end(source, at)
        elif c == "#" and (found := _WORD.match(source, at + 1)):
            kind, end = "private", found.end()
        elif found := _WORD.match(source, at):
            kind, end = ("num" if c.isdigit() else "id"), found.end()
        elif c == "/" and source[at : at + 2] == "/*":
            raise SourceError("a comment does not end")
        elif c == "/" and (last is None or last.text in _BEFORE_REGEX or last.kind == "punct" and last.text not in (")", "]", "}")) and (found := _REGEX.match(source, at)):
            kind, end = "re", found.end()
        else:
            kind, end = "punct", _PUNCT.match(source, at).end()
        last = Token(kind, source[at:end], at, end)
        yield last
        at = end


def tokens(source: str) -> list[Token]:
    """All tokens; brackets must match."""
    out, open_ = [], []
    start = source.find("\n") + 1 if source.startswith("#!") else 0
    for t in _scan(source, start):
        if t.kind == "punct":
            if t.text in PAIRS:
                open_.append(PAIRS[t.text])
            elif t.text in PAIRS.values() and (not open_ or open_.pop() != t.text):
                raise SourceError(f"unexpected {t.text} (offset {t.start})")
        out.append(t)
    if open_:
        raise SourceError(f"missing {open_[-1]}")
    return out


def closing(found: list[Token]) -> dict[int, int]:
    """For the index of each opening bracket, that of its closing one."""
    out, stack = {}, []
    for i, t in enumerate(found):
        if t.kind == "punct" and t.text in PAIRS:
            stack.append(i)
        elif t.kind == "punct" and t.text in PAIRS.values():
            out[stack.pop()] = i
    return out
