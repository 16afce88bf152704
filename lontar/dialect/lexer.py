"""Tokens, fields and statements of the query dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lontar.errors import EngineError, syntax


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


#: Marks of the dialect, the longest first.
MARKS = {
    "&&&": "tripleamp", "&&": "doubleamp", "&:": "and", "&": "amp", "-:": "endstmt", ">=": "ge", "<=": "le", ">": "gt", "<": "lt", "=": "eq",
    "(": "lparen", ")": "rparen", ".": "dot", ",": "comma", "+": "plus", "-": "minus", "*": "star", "/": "slash",
}
_WORD = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(r"[0-9]+(\.[0-9]+)?")


def quoted(text: str, at: int) -> tuple[str, int]:
    """The content of a quoted run that starts here, and its end. The quote doubled stands for itself."""
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        if text[i] == quote:
            if text[i + 1 : i + 2] != quote:
                return "".join(out), i + 1
            i += 1
        out.append(text[i])
        i += 1
    raise syntax(f"a quote at {at} is not closed")


def tokenize(text: str) -> list[Token]:
    """All tokens, with an `end` token last."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "#":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c in "'\"":
            body, end = quoted(text, i)
            out.append(Token("block" if c == "'" else "text", body, i))
            i = end
        elif m := _WORD.match(text, i):
            end = m.end()
            if m[0].upper() in ("O", "M") and text[end : end + 1] == ":":
                out.append(Token("or" if m[0].upper() == "O" else "order", text[i : end + 1], i))
                end += 1
            else:
                out.append(Token("word", m[0], i))
            i = end
        elif m := _NUMBER.match(text, i):
            out.append(Token("number", m[0], i))
            i = m.end()
        else:
            mark = next((k for k in MARKS if text.startswith(k, i)), None)
            if mark is None or (mark == "&&&" and text[i + 3 : i + 4] == "&"):
                raise syntax(f"unexpected character {c!r} at {i}")
            out.append(Token(MARKS[mark], mark, i))
            i += len(mark)
    return [*out, Token("end", "", len(text))]


def split_fields(text: str, widths: tuple[int, ...] = (1,), data: bool = False) -> list[str]:
    """Parts between runs of & of the given widths, outside quotes and (unless `data`) parentheses. &: belongs to a part."""
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            i = quoted(text, i)[1]
            continue
        if not data:
            depth += (c == "(") - (c == ")")
        if c == "&":
            run = len(text[i:]) - len(text[i:].lstrip("&"))
            if text[i + run : i + run + 1] == ":" and not data:
                run -= 1
                if run == 0:
                    i += 2
                    continue
            if depth == 0:
                if run not in widths:
                    raise syntax(f"separator {'&' * run} does not belong here")
                out.append(text[start:i].strip())
                start = i + run
            i += run
            continue
        i += 1
    out.append(text[start:].strip())
    if not data and any(not f for f in out):
        raise syntax("an empty field")
    return out


def split_statements(text: str) -> tuple[list[str], str]:
    """Complete statements, each with its terminator, and what is left."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in "'\"":
            try:
                i = quoted(text, i)[1]
            except EngineError:  # not closed yet: it belongs to the rest
                break
        elif text[i] == "#":
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            text = text[:i] + text[end:]
        elif text.startswith("-:", i):
            out.append(text[start : i + 2].strip())
            i += 2
            start = i
        else:
            i += 1
    return out, text[start:]
