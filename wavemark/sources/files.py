"""Small files and finished folders on whatever file system a path names, by Hadoop's interface.

Paths are those that Spark's readers and writers take. What is written comes into being whole: it is
made under a hidden name beside its place and moved there at the end, so that a run that is stopped
leaves nothing half done that a reader would see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _place(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return (system.getRawFileSystem() if system.getScheme() == "file" else system), place  # no checksum files beside local ones


def exists(path: str) -> bool:
    system, place = _place(path)
    return system.exists(place)


def is_folder(path: str) -> bool:
    system, place = _place(path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def names(path: str) -> list[str]:
    """The names in a folder that are not hidden."""
    system, place = _place(path)
    return sorted(n for n in (s.getPath().getName() for s in system.listStatus(place)) if not n.startswith((".", "_")))


def make_folder(path: str) -> None:
    system, place = _place(path)
    system.mkdirs(place)


def delete(path: str) -> None:
    """The file or folder with all that is in it; nothing if it is not there."""
    system, place = _place(path)
    system.delete(place, True)


def read_text(path: str) -> str:
    system, place = _place(path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


@contextmanager
def replacing(path: str) -> Iterator[str]:
    """A hidden path to write to. At the end it takes the place of what stands at ``path``; if the
    block fails it is removed, and ``path`` stays as it was."""
    folder, _, name = path.rstrip("/").rpartition("/")
    hidden = f"{folder or '.'}/.{name}-{uuid.uuid4().hex}"
    try:
        yield hidden
        system, place = _place(path)
        system.delete(place, True)
        if not system.rename(_place(hidden)[1], place):
            raise OSError(f"cannot move {hidden} to {path}")
    except BaseException:
        delete(hidden)
        raise


def write_text(path: str, text: str) -> None:
    folder = path.rpartition("/")[0]
    if folder:
        make_folder(folder)
    with replacing(path) as hidden:
        system, place = _place(hidden)
        stream = system.create(place)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
