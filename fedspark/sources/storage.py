"""Random access to files for Python data sources: local paths and the stores that Arrow opens by their address."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, by path; those below names that begin with _ or . are passed over."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part[:1] in "_." for part in p[len(root) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and not hidden(f.path))


#: Bytes that opening a file counts as.
FILE_COST = 1 << 20


def packed(items: Iterable[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Items in their order, in runs of about `most` bytes, FILE_COST for each added; one that is larger stands alone."""
    run, size = [], 0
    for name, n in items:
        n += FILE_COST
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(name)
        size += n
    if run:
        yield run


def put(store: fs.FileSystem, path: str, data: bytes, there: set[str] | None = None) -> None:
    """Writes a file that others see whole or not at all: under another name first, so a task may be repeated or run twice.
    `there` keeps the folders that were made already."""
    folder, _, name = path.rpartition("/")
    if there is None or folder not in there:
        store.create_dir(folder, recursive=True)
        if there is not None:
            there.add(folder)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    store.move(hidden, path)
