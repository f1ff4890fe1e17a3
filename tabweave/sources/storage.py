"""Small files by path or URL, on the driver and on Python workers alike: local folders and whatever Arrow can open."""

from __future__ import annotations

import fnmatch
import os
import uuid

from pyarrow import fs


def absolute(path: str) -> str:
    """Without a trailing slash; local paths (``file:`` URLs too) from the root."""
    path = str(path)
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return path.rstrip("/") if "://" in path else os.path.realpath(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    path = absolute(path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def exists(path: str) -> bool:
    system, p = opened(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def read_text(path: str) -> str:
    system, p = opened(path)
    with system.open_input_stream(p, compression=None) as f:
        return f.read().decode("utf-8")


def make_folder(path: str) -> None:
    system, p = opened(path)
    system.create_dir(p, recursive=True)


def write_text(path: str, text: str) -> None:
    """All or nothing: a task that runs again, or a reader beside it, never meets half a file."""
    system, p = opened(path)
    folder, _, name = p.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as f:
        f.write(text.encode("utf-8"))
    system.move(part, p)


def names(folder: str, pattern: str = "*") -> list[str]:
    """Names of a folder's files, in order; none if there is no such folder."""
    system, p = opened(folder)
    found = system.get_file_info(fs.FileSelector(p, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern))
