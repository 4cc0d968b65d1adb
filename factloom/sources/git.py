"""Revision, branch and remote of a repository, read from its files; never fails."""

from __future__ import annotations

import configparser
import os
from pathlib import Path


def resolve_git(root: str) -> dict[str, str | None]:
    """revision, branch and remote, null where the folder doesn't tell."""
    out: dict[str, str | None] = {"revision": None, "branch": None, "remote": None}
    try:
        folder = Path(root) / ".git"
        if folder.is_file():  # a worktree names its folder
            folder = (Path(root) / folder.read_text().partition("gitdir:")[2].strip()).resolve()
        head = (folder / "HEAD").read_text().strip()
        if head.startswith("ref:"):
            ref = head[4:].strip()
            out["branch"] = ref.removeprefix("refs/heads/")
            loose = folder / ref
            if loose.is_file():
                out["revision"] = loose.read_text().strip()
            else:
                packed = dict(reversed(line.split(" ", 1)) for line in (folder / "packed-refs").read_text().splitlines() if " " in line and line[0] not in "#^")
                out["revision"] = packed.get(ref)
        else:
            out["revision"] = head
    except (OSError, ValueError):
        pass
    try:
        config = configparser.ConfigParser(strict=False, interpolation=None)
        config.read(Path(root) / ".git" / "config")
        out["remote"] = config.get('remote "origin"', "url", fallback=None)
    except (OSError, configparser.Error):
        pass
    return out


def cache_key(root: str) -> str:
    return resolve_git(root)["revision"] or "nogit"


def sandbox_path(root: str, candidate: str) -> str:
    """The real path of a candidate below the root; another raises."""
    top, real = os.path.realpath(root), os.path.realpath(os.path.join(root, candidate))
    if real != top and not real.startswith(top + os.sep):
        raise ValueError(f"{candidate} lies outside {root}")
    return real
