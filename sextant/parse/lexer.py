"""Tokens of JavaScript and TypeScript, one at a time: the parser says where a regular expression or markup may start."""

from __future__ import annotations

import re
from typing import NamedTuple


class SyntaxFailure(Exception):
    """Source that the grammar doesn't cover."""


class Token(NamedTuple):
    kind: str  # name, number, string, punct, private, regex, end
    text: str
    start: int
    end: int
    newline: bool  # a line ends between the token before and this one


_BLANK = re.compile(r"(?:\s+|\ufeff|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*")
_NAME = re.compile(r"(?:[A-Za-z_$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r""""(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'""")
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`]")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}


def unescape(raw: str) -> str:
    """The value of the inside of a string or template."""
    if "\\" not in raw:
        return raw
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _SHORT.get(m[4], m[4]), raw)


def blank_end(src: str, pos: int) -> int:
    return _BLANK.match(src, pos).end()


def token(src: str, pos: int) -> Token:
    """The next token; a slash is punctuation here."""
    start = blank_end(src, pos)
    newline = "\n" in src[pos:start] or "\r" in src[pos:start]
    if start >= len(src):
        return Token("end", "", start, start, True)
    c = src[start]
    if c in "\"'":
        m, kind = _STRING.match(src, start), "string"
    elif c.isdigit() or (c == "." and src[start + 1 : start + 2].isdigit()):
        m, kind = _NUMBER.match(src, start), "number"
    elif c == "#":
        m, kind = _NAME.match(src, start + 1), "private"
    elif m := _PUNCT.match(src, start):
        kind = "punct"
    else:
        m, kind = _NAME.match(src, start), "name"
    if not m:
        raise SyntaxFailure(f"unexpected character {c!r} at {start}")
    return Token(kind, src[start : m.end()], start, m.end(), newline)


def regex(src: str, start: int) -> Token:
    m = _REGEX.match(src, start)
    if not m:
        raise SyntaxFailure(f"unterminated regular expression at {start}")
    return Token("regex", m[0], start, m.end(), False)
