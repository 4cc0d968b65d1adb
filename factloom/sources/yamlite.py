"""The part of YAML that manifests use: nested mappings, lists, quoted and plain scalars, block texts, flow lists."""

from __future__ import annotations

import re


def documents(text: str) -> list:
    """Every document of a text; one that can't be read is left out."""
    out = []
    for part in re.split(r"(?m)^---.*$", text):
        try:
            value = parse(part)
        except (ValueError, IndexError):
            continue
        if value is not None:
            out.append(value)
    return out


def scalar(s: str):
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [scalar(x) for x in _flow(s[1:-1])]
    if s.startswith("{") and s.endswith("}"):
        return {k.strip().strip("\"'"): scalar(v) for k, v in (x.split(":", 1) for x in _flow(s[1:-1]) if ":" in x)}
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    return int(s) if re.fullmatch(r"-?\d+", s) else s


def _flow(s: str) -> list[str]:
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[start:i])
            start = i + 1
    return [x for x in [*out, s[start:]] if x.strip()]


def parse(text: str):
    lines = []
    for raw in text.split("\n"):
        body = re.sub(r"(^|\s)#.*$", "", raw) if not re.search(r"[\"'].*#.*[\"']", raw) else raw
        if body.strip():
            lines.append((len(body) - len(body.lstrip()), body.strip(), raw))
    value, at = _block(lines, 0, lines[0][0] if lines else 0)
    if at < len(lines):
        raise ValueError("uneven indentation")
    return value


def _block(lines: list, at: int, indent: int):
    if at >= len(lines):
        return None, at
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        out = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:].strip()
            inner = indent + len(lines[at][1]) - len(lines[at][1][1:].lstrip()) if rest else 0
            if not rest:
                at += 1
                value, at = _block(lines, at, lines[at][0]) if at < len(lines) and lines[at][0] > indent else (None, at)
            elif _pair(rest):
                lines[at] = (inner, rest, lines[at][2])
                value, at = _block(lines, at, inner)
            else:
                value, at = scalar(rest), at + 1
            out.append(value)
        return out, at
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        pair = _pair(lines[at][1])
        if not pair:
            if not out:
                return scalar(lines[at][1]), at + 1
            raise ValueError("no key")
        key, rest = pair
        at += 1
        if rest in ("|", ">", "|-", ">-", "|+", ">+"):
            held = []
            while at < len(lines) and lines[at][0] > indent:
                held.append(lines[at][1])
                at += 1
            out[key] = ("\n" if rest[0] == "|" else " ").join(held)
        elif rest:
            out[key] = scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
            out[key], at = _block(lines, at, lines[at][0])
        else:
            out[key] = None
    return out, at


def _pair(s: str):
    m = re.match(r"""("[^"]*"|'[^']*'|[^\s"'\[{][^:]*?|[^\s:]+)\s*:(?:\s+(.*)|$)""", s)
    return (m[1].strip("\"'"), (m[2] or "").strip()) if m else None
