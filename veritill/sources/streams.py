"""Files opened from tasks as byte streams, by whatever file system their address names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pf


def file_system(path: str) -> tuple[pf.FileSystem, str]:
    """The file system of an address and the path in it; an address without a scheme, or with `file:`, is local."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) or path.startswith("file:"):
        return pf.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pf.FileSystem.from_uri(path)


def chunks(path: str, size: int = 8 << 20) -> Iterator[bytes]:
    """A file in pieces, so that a task holds one of them whatever the file's length."""
    fs, at = file_system(path)
    with fs.open_input_stream(at) as stream:
        while piece := stream.read(size):
            yield piece


def below(path: str, ending: str) -> list[str]:
    """The files under a folder, or the file itself, with an ending in any case, in order of their names."""
    fs, at = file_system(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = fs.get_file_info(at)
    found = [info] if info.type == pf.FileType.File else fs.get_file_info(pf.FileSelector(at, recursive=True))
    own = re.match(r"[a-z0-9+.-]+://[^/]*", path) if scheme and not path.startswith("file:") else None
    prefix = own[0] if own else "file://" if scheme else ""
    return sorted(f"{prefix}{'' if not prefix or f.path.startswith('/') else '/'}{f.path}" for f in found if f.type == pf.FileType.File and f.path.lower().endswith(ending))
