"""Files opened inside tasks: random access, staging and renames, by the scheme of the path."""

from __future__ import annotations

import re

#: Schemes whose files tasks can open and seek in; others are read by Spark, whole.
SEEKABLE = {"", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"}


def scheme_of(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def system_of(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", path[len(scheme) + 1 :] if scheme else path)
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def open_file(path: str):
    """A file to read and seek in."""
    system, inner = system_of(path)
    return system.open_input_file(inner)


def found_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder but for hidden ones (names with ``_`` or ``.`` first)."""
    from pyarrow import fs

    system, inner = system_of(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(head + info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File]
    hidden = lambda x: any(part[:1] in "_." for part in x.path.removeprefix(inner).split("/") if part)
    return sorted((head + x.path, x.size) for x in below if not hidden(x))


def read_exactly(f, start: int, length: int) -> bytes:
    """The bytes from ``start`` on, up to ``length`` of them; nothing else of the file is read."""
    f.seek(start)
    parts = []
    while length > 0:
        data = f.read(length)
        if not data:
            break
        parts.append(bytes(data))
        length -= len(data)
    return b"".join(parts)
