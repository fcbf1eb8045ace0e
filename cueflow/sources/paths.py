"""Files by name, as tasks see them: listing, reading, writing in two steps. Plain paths are local, others are URIs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Given paths of a partition of the source.
SLICE = 256


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def failure_of(number: int | None) -> str:
    """Failure for an operating system's error number."""
    return {5: "permissionDenied", 13: "permissionDenied", 2: "readFailed", 3: "readFailed"}.get(number or 0, "cannotWriteOutput")


def listed(path: str, extensions: set[str]) -> Iterator[tuple[str, str]]:
    """(lower-case name, path) of a folder's own files with one of the extensions; ("", path) for anything else.

    A folder that can't be looked at any further gives what it has given so far.
    """
    from pyarrow import fs

    try:
        system, at = _system(path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            yield "", path
            return
        found = system.get_file_info(fs.FileSelector(at))
    except (OSError, ValueError):
        yield "", path
        return
    for x in found:
        name = x.base_name.lower()
        if x.type == fs.FileType.File and "." in name and name.rpartition(".")[2] in extensions:
            yield name, f"{path.rstrip('/')}/{x.base_name}"


class Slice(InputPartition):
    def __init__(self, first: int, paths: list[str]):
        self.first, self.paths = first, paths


class _Lister(DataSourceReader):
    def __init__(self, options):
        self.paths, self.extensions = json.loads(options["paths"]), set(json.loads(options["extensions"]))

    def partitions(self):
        return [Slice(i, self.paths[i : i + SLICE]) for i in range(0, len(self.paths), SLICE)] or [Slice(0, [])]

    def read(self, partition):
        for i, path in enumerate(partition.paths):
            for name, found in listed(path, self.extensions):
                yield partition.first + i, name, found


class PathList(DataSource):
    """nth, name and path of what a list of paths (option ``paths``, JSON) stands for; each task looks at a slice of the list."""

    @classmethod
    def name(cls):
        return "cueflow_paths"

    def schema(self):
        return "nth int, name string, path string"

    def reader(self, schema):
        return _Lister(self.options)


def file_bytes(path: str) -> bytes | None:
    """A file's bytes; null if it is missing or can't be read."""
    try:
        system, at = _system(path)
        with system.open_input_stream(at) as f:
            return f.read()
    except (OSError, ValueError):
        return None


def names_in(folder: str) -> list[str]:
    """Paths of all that a folder holds itself; none if it can't be looked at."""
    from pyarrow import fs

    try:
        system, at = _system(folder or ".")
        return [f"{folder.rstrip('/')}/{x.base_name}" if folder else x.base_name for x in system.get_file_info(fs.FileSelector(at))]
    except (OSError, ValueError):
        return []


def write_part(folder: str, data: bytes, mark: str) -> tuple[str | None, str | None]:
    """(the name that the bytes were written under in the folder, null), or (null, failure)."""
    part = None
    try:
        part = f"{folder.rstrip('/')}/{mark}.{uuid.uuid4().hex}.part" if folder else f"{mark}.{uuid.uuid4().hex}.part"
        system, at = _system(part)
        with system.open_output_stream(at) as out:
            out.write(data)
        return part, None
    except Exception as e:  # whatever a file system raises, the row says that it was not written
        if part:
            remove(part)
        return None, failure_of(getattr(e, "errno", None))


def settle_part(part: str, to: str) -> str | None:
    """Gives a part its name, also if an earlier attempt has done so; the failure, or null."""
    try:
        system, at = _system(part)
        target = _system(to)[1]
        try:
            system.move(at, target)
        except FileNotFoundError:
            # An attempt that was lost after the move has done it; else there is no such file, and this raises.
            system.open_input_stream(target).close()
        return None
    except Exception as e:
        remove(part)
        return failure_of(getattr(e, "errno", None))


def remove(part: str | None) -> None:
    try:
        if part:
            system, at = _system(part)
            system.delete_file(at)
    except OSError:
        pass


def sweep(batches, mark: str):
    """Removes what has ``mark`` in the folders; a folder that is gone has none."""
    from pyarrow import fs

    for b in batches:
        for folder in b.column(0).to_pylist():
            try:
                system, at = _system(folder or ".")
                for x in system.get_file_info(fs.FileSelector(at)):
                    if x.base_name.startswith(mark):
                        system.delete_file(x.path)
            except OSError:
                continue
        yield b
