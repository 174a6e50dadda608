"""Byte access to raster files, and what else is done with them: local paths, and anything else through Arrow's file systems."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import shutil

from tilewright.cube import RasterError


def _remote(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path)


def local(path: str) -> str | None:
    if path.startswith("file:"):
        return re.sub("^file:(//)?", "", path)
    return None if re.match(r"[a-z][a-z0-9+.-]+://", path) else path


def read_range(path: str, at: int, size: int) -> bytes:
    place = local(path)
    try:
        if place is not None:
            with open(place, "rb") as f:
                f.seek(at)
                return f.read(size)
        fs, name = _remote(path)
        with fs.open_input_file(name) as f:
            return f.read_at(min(size, max(0, f.size() - at)), at)
    except OSError as e:
        raise RasterError(f"Could not open file: {path}") from e


def read_all(path: str) -> bytes:
    place = local(path)
    try:
        if place is not None:
            with open(place, "rb") as f:
                return f.read()
        fs, name = _remote(path)
        with fs.open_input_file(name) as f:
            return f.read()
    except OSError as e:
        raise RasterError(f"Could not open file: {path}") from e


def exists(path: str) -> bool:
    try:
        read_range(path, 0, 1)
        return True
    except RasterError:
        return False


def glob(pattern: str) -> list[str]:
    """Files that match a pattern, in order of name."""
    place = local(pattern)
    if place is not None:
        import glob as plain

        found = sorted(plain.glob(place))
    else:
        import pyarrow.fs

        fs, name = _remote(pattern)
        folder = name.rsplit("/", 1)[0]
        head = pattern[: len(pattern) - len(name)]
        found = sorted(head + i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if fnmatch.fnmatch(i.path, name))
    if not found:
        raise RasterError(f"No files found that match the pattern: {pattern}")
    return found


def siblings(path: str) -> list[str]:
    """The names of the other files in a file's folder."""
    place = local(path)
    if place is not None:
        folder, name = os.path.split(os.path.abspath(place))
        return sorted(n for n in os.listdir(folder) if n != name and os.path.isfile(os.path.join(folder, n)))
    import pyarrow.fs

    fs, name = _remote(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(name.rsplit("/", 1)[0]))
    return sorted(i.base_name for i in found if i.is_file and i.path != name)


def make_folder(path: str) -> None:
    """The folder and those above it; one that is there already is left alone."""
    if (place := local(path)) is not None:
        os.makedirs(place, exist_ok=True)
    else:
        fs, name = _remote(path)
        fs.create_dir(name, recursive=True)


def move(path: str, to: str) -> None:
    """Renames a file, over one that is there."""
    place, target = local(path), local(to)
    if place is not None and target is not None:
        os.replace(place, target)
    elif place is None and target is None:
        (fs, name), (_, new) = _remote(path), _remote(to)
        fs.move(name, new)
    else:
        upload(place, to) if place is not None else _download(path, target)
        remove(path)


def remove(path: str) -> None:
    """Deletes a file or a folder with all in it; what is not there is no error."""
    if (place := local(path)) is not None:
        if os.path.isdir(place):
            shutil.rmtree(place, ignore_errors=True)
        elif os.path.exists(place):
            os.remove(place)
        return
    import pyarrow.fs

    fs, name = _remote(path)
    kind = fs.get_file_info(name).type
    if kind == pyarrow.fs.FileType.Directory:
        fs.delete_dir(name)
    elif kind == pyarrow.fs.FileType.File:
        fs.delete_file(name)


def upload(place: str, to: str) -> None:
    """Copies a local file to any path."""
    with open(place, "rb") as f, open_stream(to) as out:
        shutil.copyfileobj(f, out, 1 << 22)


def _download(path: str, place: str) -> None:
    fs, name = _remote(path)
    with fs.open_input_stream(name) as f, open(place, "wb") as out:
        shutil.copyfileobj(f, out, 1 << 22)


def open_stream(path: str):
    """A file to write from its beginning to its end, anywhere; its folder is made."""
    if (place := local(path)) is not None:
        os.makedirs(os.path.dirname(os.path.abspath(place)), exist_ok=True)
        return open(place, "wb")
    fs, name = _remote(path)
    if "/" in name:
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(name)


def open_output(path: str) -> io.IOBase:
    place = local(path)
    if place is None:
        raise RasterError(f"Rasters are written to mounted paths: {path}")
    os.makedirs(os.path.dirname(os.path.abspath(place)), exist_ok=True)
    return open(place, "wb+")
