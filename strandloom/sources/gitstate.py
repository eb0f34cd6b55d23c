"""What git tells of a source tree, from the driver."""

from __future__ import annotations

import os
import subprocess
import time


def git(folder: str, *words: str) -> str | None:
    """What the command prints; None if it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True)
    except OSError:
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def local_path(root: str) -> str | None:
    """The folder of a path on this machine's disk, or None."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return None if "://" in root else root


def head(root: str) -> str:
    """The commit that is checked out, or ""."""
    folder = local_path(root)
    return (git(folder, "rev-parse", "HEAD") if folder else None) or ""


def changed_files(root: str, since: str) -> list[str] | None:
    """Paths below ``root`` that differ from a commit: in later commits, in the working tree, or new.

    None where git can't tell, as outside of a repository or with a commit it doesn't know.
    """
    folder = local_path(root)
    if not folder or not since:
        return None
    prefix, committed = git(folder, "rev-parse", "--show-prefix"), git(folder, "diff", "--name-only", "--no-renames", "-z", f"{since}..HEAD")
    edited = git(folder, "diff", "--name-only", "--no-renames", "-z", "HEAD")
    fresh = git(folder, "ls-files", "--others", "--exclude-standard", "--full-name", "-z")
    if prefix is None or committed is None or edited is None or fresh is None:
        return None
    paths = {p for text in (committed, edited, fresh) for p in text.split("\0") if p.startswith(prefix)}
    return sorted(f"{root.rstrip('/')}/{p[len(prefix):]}" for p in paths if p)


def describe(folder: str) -> dict:
    """Branch, worktree, distance to its upstream, edits and age of the last fetch."""
    place = git(folder, "rev-parse", "--git-dir")
    out = {"git_available": place is not None, "branch": "", "is_worktree": False, "ahead_behind": "", "worktree_root": "", "dirty_count": 0, "staged_count": 0, "last_fetch_ts": 0, "last_fetch_age": None}
    if place is None:
        return out
    lines = lambda *words: len((git(folder, *words) or "").splitlines())
    out |= {"branch": git(folder, "rev-parse", "--abbrev-ref", "HEAD") or "", "is_worktree": "worktrees" in place, "worktree_root": git(folder, "rev-parse", "--show-toplevel") or ""}
    out |= {"dirty_count": lines("diff", "--name-only"), "staged_count": lines("diff", "--cached", "--name-only")}
    if both := git(folder, "rev-list", "--count", "--left-right", "@{u}...HEAD"):
        behind, ahead = both.split()
        out["ahead_behind"] = f"{ahead}/{behind}"
    fetched = os.path.join(folder, git(folder, "rev-parse", "--git-common-dir") or "", "FETCH_HEAD")
    if os.path.exists(fetched):
        out["last_fetch_ts"] = int(os.path.getmtime(fetched))
        out["last_fetch_age"] = int(time.time()) - out["last_fetch_ts"]
    return out
