"""A synthetic repository of Python modules that import and call each other, for timings."""

from __future__ import annotations

from pathlib import Path


def module(i: int, files: int, lines: int) -> str:
    """Source of the i-th module: a function for about every ten lines, every third statement of which calls another module's helper."""
    out = [f"# module mod_{i:04}", f"from mod_{i - 1:04} import helper_{i - 1:04}" if i else "import os", f"def helper_{i:04}(a: int, b: int) -> int:", "    return a + b"]
    for s in range(max(2, lines // 10 - 1)):
        out += [f"def func_{s:03}(a: int, b: int) -> int:", f'    """func_{s:03} computes a value."""']
        out += [f"    r = helper_{(i + k) % files:04}(a, {k})" if i and k % 3 == 0 else f"    r = a + {k} * b" for k in range(6)]
        out.append("    return r")
    return "\n".join([*out, *["# padding comment for realistic size"] * max(0, lines - len(out))]) + "\n"


def generate_repo(folder: str, files: int, lines: int) -> int:
    """Write the modules below ``folder``; returns the number of lines."""
    root, n = Path(folder), 0
    root.mkdir(parents=True, exist_ok=True)
    for i in range(files):
        text = module(i, files, lines)
        (root / f"mod_{i:04}.py").write_text(text)
        n += text.count("\n")
    return n
