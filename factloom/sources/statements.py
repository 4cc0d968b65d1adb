"""Statements of brace languages: comments gone, lines joined that go on inside brackets or as a chain of calls."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _CHARACTER = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\[^'\n]+|[^'\\\n])'"
#: What a scan stops at besides brackets and line ends: comments and literals of each language.
_LITERALS = {
    "typescript": rf"{_COMMENT}|{_DOUBLE}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?<=[=(,:!&|?;\[])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    "go": rf"{_COMMENT}|{_DOUBLE}|`[^`]*`?|{_CHARACTER}",
    "java": rf'{_COMMENT}|"""(?:\\.|[^\\])*?(?:"""|\Z)|{_DOUBLE}|{_CHARACTER}',
    "rust": rf'{_COMMENT}|r(?P<hash>#+)".*?(?:"(?P=hash)|\Z)|r"[^"]*"?|"(?:\\.|[^"\\])*"?|{_CHARACTER}',
}
_LITERALS["javascript"] = _LITERALS["typescript"]
_STOPS = {name: re.compile(rf"{literals}|[()\[\]{{}}]|\n", re.DOTALL) for name, literals in _LITERALS.items()}
_GROUP = re.compile(r"\s*(import|const|var|type)\s*$")  # Go's groups in round brackets
# Before the braces of imported names, and of annotations.
_LIST = re.compile(r"\s*(?:import|export)\b(?!\s+default)[^(=]*$|\s*(?:pub(?:\([^)]*\))?\s+)?use\b[^(=]*$|\s*@[\w.]+\([^)]*$")
_DECLARES = re.compile(r"\b(class|function|interface|enum|namespace|module|type)\s+\w")
_CHAINED = re.compile(r"\s*\??\.[A-Za-z_]")
_INDENT = re.compile(r"[ \t\r]*")
_CLOSES = {")": "(g", "]": "[", "}": "{i"}


@dataclass
class Statement:
    """One statement: its text, and the same text with literals blanked (``bare``, equal places)."""

    line: int
    text: str = ""
    bare: str = ""
    marks: list[tuple[int, int]] = field(default_factory=list)  # place in the text, line

    def at(self, place: int) -> int:
        """The line of a place of the text."""
        return self.marks[max(0, bisect_right(self.marks, (place, 1 << 60)) - 1)][1] if self.marks else self.line


def statements(language: str, text: str) -> Iterator[Statement]:
    """Statements in order. A line ends one unless a round or square bracket is open last, or the next line goes on with a call.

    Members of Go's groups (``import (``, ``const (``) get the group's word in front. Brackets without partners and open
    literals don't fail: a closing bracket takes off what it can.
    """
    stops = _STOPS[language]
    texts: list[str] = []
    bares: list[str] = []
    marks: list[tuple[int, int]] = []
    open_: list[str] = []
    group, size, line, at = "", 0, 1, 0

    def add(part: str, bare: str | None = None) -> None:
        nonlocal size
        if part:
            texts.append(part)
            bares.append(part if bare is None else bare)
            size += len(part)

    def done() -> Statement | None:
        nonlocal texts, bares, marks, size
        whole = Statement(marks[0][1], "".join(texts).rstrip(), "".join(bares).rstrip(), marks) if marks else None
        texts, bares, marks, size = [], [], [], 0
        return whole if whole and whole.text.strip() not in ("", group) else None

    def begin() -> None:
        if open_ and open_[-1] == "g" and not size and group:
            add(f"{group} ")
        marks.append((size, line))

    begin()
    for m in stops.finditer(text):
        add(text[at : m.start()])
        at, token = m.end(), m[0]
        if token == "\n":
            line += 1
            if open_ and open_[-1] in "([i" or size and (texts[-1].endswith(".") or _CHAINED.match(text, at)) and "".join(bares).strip() not in ("", group):
                add(" ")
                at = _INDENT.match(text, at).end()
                marks.append((size, line))
                continue
            if found := done():
                yield found
            begin()
        elif token in "([{":
            if token == "(" and language == "go" and size < 99 and (word := _GROUP.match("".join(texts))):
                open_.append("g")
                group = word[1]
                done()
                begin()
                continue
            names = token == "{" and language != "go" and size < 999 and _LIST.match("".join(bares))
            open_.append("i" if names and not _DECLARES.search("".join(bares)) else token)
            add(m[0])
        elif token in ")]}":
            if any(o in _CLOSES[token] for o in open_):
                while open_ and (last := open_.pop()) not in _CLOSES[token]:
                    pass
                if last == "g":
                    if found := done():
                        yield found
                    group = ""
                    begin()
                    continue
            add(token)
        elif token.startswith(("//", "/*")):
            line += token.count("\n")
            add(" ")
        else:
            add(token, token[0] + " " * (len(token) - 2) + token[-1] if len(token) > 1 else token)
            line += token.count("\n")
    add(text[at:])
    if found := done():
        yield found
