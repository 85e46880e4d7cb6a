"""Files by path: local ones directly, others through pyarrow's file systems."""

from __future__ import annotations

import glob
import os


def local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_read(path: str):
    at = local(path)
    if at is not None:
        return open(at, "rb")
    system, name = _remote(path)
    return system.open_input_file(name)


def open_write(path: str):
    at = local(path)
    if at is not None:
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        return open(at, "wb")
    system, name = _remote(path)
    system.create_dir(name.rpartition("/")[0])
    return system.open_output_stream(name)


def size(path: str) -> int:
    at = local(path)
    if at is not None:
        return os.path.getsize(at)
    system, name = _remote(path)
    return system.get_file_info(name).size


def stamp(path: str) -> tuple:
    """Size and time of the last change: what was read of a file holds while they are the same."""
    at = local(path)
    if at is not None:
        info = os.stat(at)
        return info.st_ino, info.st_size, info.st_mtime_ns
    system, name = _remote(path)
    info = system.get_file_info(name)
    return info.size, info.mtime_ns


def exists(path: str) -> bool:
    at = local(path)
    if at is not None:
        return os.path.exists(at)
    system, name = _remote(path)
    return system.get_file_info(name).type.name != "NotFound"


def move(source: str, target: str) -> None:
    at, to = local(source), local(target)
    if at is not None and to is not None:
        os.replace(at, to)
        return
    system, name = _remote(source)
    system.move(name, _remote(target)[1])


def remove(path: str) -> None:
    import shutil

    at = local(path)
    if at is not None:
        shutil.rmtree(at) if os.path.isdir(at) else os.path.exists(at) and os.remove(at)
        return
    system, name = _remote(path)
    info = system.get_file_info(name)
    if info.type.name == "Directory":
        system.delete_dir(name)
    elif info.type.name == "File":
        system.delete_file(name)


def listing(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder, or of those that a pattern matches, in order of name."""
    at = local(path)
    if at is not None:
        if os.path.isdir(at):
            found = [os.path.join(d, n) for d, _, names in os.walk(at) for n in names if not n.startswith((".", "_"))]
        else:
            found = glob.glob(at) if any(c in at for c in "*?[") else [at]
        if not found or not all(map(os.path.exists, found)):
            raise FileNotFoundError(path)
        return [(f, os.path.getsize(f)) for f in sorted(found)]
    from pyarrow import fs

    system, name = _remote(path)
    scheme = path.partition("://")[0]
    info = system.get_file_info(name)
    infos = system.get_file_info(fs.FileSelector(name, recursive=True)) if info.type.name == "Directory" else [info]
    found = sorted((f"{scheme}://{i.path.lstrip('/') if scheme == 's3' else i.path}", i.size) for i in infos if i.type.name == "File" and not i.base_name.startswith((".", "_")))
    if not found:
        raise FileNotFoundError(path)
    return found
