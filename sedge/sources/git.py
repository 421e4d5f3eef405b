"""Shallow clone on the driver, before a plan starts (SRC-1)."""

from __future__ import annotations

import subprocess

from ..errors import IndexingError

TIMEOUT_S = 600


def clone(url: str, destination: str, timeout: float = TIMEOUT_S) -> None:
    try:
        done = subprocess.run(["git", "clone", "--depth=1", "--", url, destination], capture_output=True, text=True, timeout=timeout)
    except FileNotFoundError as e:
        raise IndexingError("git was not found on the path.") from e
    except subprocess.TimeoutExpired as e:
        raise IndexingError(f"Cloning took more than {timeout:g} s.") from e
    if done.returncode:
        raise IndexingError(done.stderr.strip() or "Cloning failed.")
