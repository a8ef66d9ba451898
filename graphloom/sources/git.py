"""What git says of a working tree."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

_HUNK = re.compile(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def _git(root: Path, *args: str) -> subprocess.CompletedProcess[str]:
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, errors="replace")


def head(root: Path) -> str | None:
    """The commit of HEAD; None without git, a repository or a commit."""
    try:
        out = _git(root, "rev-parse", "HEAD")
    except OSError:
        return None
    return out.stdout.strip() if out.returncode == 0 else None


def status(root: Path) -> str | None:
    try:
        out = _git(root, "status", "--porcelain", "-uall")
    except OSError:
        return None
    return out.stdout if out.returncode == 0 else None


def porcelain_paths(text: str) -> list[str]:
    """Every path of a short status, both sides of a rename."""
    sides = [side for line in text.splitlines() if len(line) >= 4 for side in line[3:].strip().split(" -> ", 1)]
    return [s.strip('"') for s in sides]


def diff(root: Path, rev: str | None = None, staged: bool = False) -> str:
    """A diff without context; staged changes if asked for, else against rev."""
    if not staged and rev is None:
        raise ValueError("either a revision or staged changes must be asked for")
    out = _git(root, "diff", "--unified=0", "--staged" if staged else rev)
    if out.returncode:
        raise ValueError(f"git diff failed (exit {out.returncode}): {out.stderr.strip()}")
    return out.stdout


def parse_diff(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[str]]:
    """(changed lines of the new side by file, deleted files); a pure deletion marks the line it is at."""
    changed: dict[str, list[tuple[int, int]]] = {}
    deleted: list[str] = []
    old = new = None
    for line in text.splitlines():
        if line.startswith("--- "):
            old = _path(line[4:])
        elif line.startswith("+++ "):
            new = _path(line[4:])
            if new is None and old is not None:
                deleted.append(old)
        elif new is not None and (m := _HUNK.match(line)):
            start, length = int(m[1]), int(m[2] or 1)
            changed.setdefault(new, []).append((start, start + max(length, 1) - 1))
    return changed, deleted


def _path(side: str) -> str | None:
    side = side.strip()
    return None if side == "/dev/null" else re.sub("^[ab]/", "", side, count=1)
