"""Files that tasks read by byte ranges, from any store that Arrow's file systems reach."""

from __future__ import annotations

import fnmatch
import os
from urllib.parse import unquote, urlparse

from pyarrow import fs


def split(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; file: URIs with one or three slashes and plain paths are local."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(u.path)) if u.scheme else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether this library can open the path itself; others are left to Spark's own readers."""
    try:
        store, at = split(path)
        return store.get_file_info(at).type != fs.FileType.NotFound
    except (ValueError, OSError, ImportError, NotImplementedError):
        return False


def listed(path: str, pattern: str) -> list[str]:
    """The path itself, or the files below it whose names match, in order; as paths that `split` takes."""
    store, at = split(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if store.get_file_info(at).type == fs.FileType.File:
        return [prefix + at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), pattern))


def local(path: str) -> str | None:
    """The path on a mounted file system, where it is on one."""
    store, at = split(path)
    return at if isinstance(store, fs.LocalFileSystem) else None
