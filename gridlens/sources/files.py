"""Files by the names that Spark gives them, on any file system that Arrow knows."""

from __future__ import annotations

import fnmatch
import os

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it. ``s3a`` and ``s3n`` are names of ``s3``; a path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, patterns: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in nanoseconds) of the files below a folder, or of a single file."""
    system, inner = file_system(uri)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = uri.rstrip("/")
    return sorted(
        (prefix if f.path == inner else prefix + f.path[len(inner.rstrip("/")):], f.size, f.mtime_ns or 0)
        for f in found if f.type == fs.FileType.File and (f.path == inner or any(fnmatch.fnmatch(f.base_name, p) for p in patterns)))


def open_file(uri: str):
    """A seekable file."""
    system, inner = file_system(uri)
    return open(inner, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
