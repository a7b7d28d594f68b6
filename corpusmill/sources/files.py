"""Files of the data sources: opened through ``pyarrow.fs`` where Spark's tasks run."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem


def file_system(path: str) -> tuple[FileSystem, str]:
    """(file system, path within it) of a path or URI."""
    if re.match(r"[a-z][a-z0-9+.-]+:/", path) and not path.startswith("file:"):
        return FileSystem.from_uri(path)
    return LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*", "/", path))


def entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """(name, bytes, whether it is a folder) of what is in a folder; links and special files are left out."""
    fs, at = file_system(path)
    if isinstance(fs, LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, 0, True
                elif e.is_file(follow_symlinks=False):
                    yield e.name, e.stat().st_size, False
    else:
        for e in fs.get_file_info(FileSelector(at)):
            if e.type in (FileType.Directory, FileType.File):
                yield e.base_name, e.size or 0, e.type == FileType.Directory
