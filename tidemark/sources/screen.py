"""Screen shots as a data source, ``spark.read.format("screen")`` or ``readStream`` (section 2.1 #5).

What is shown on a screen comes from a backend: a folder of shots here, one PNG
for each monitor, named ``<shot>-<monitor>.png``.  Monitors are listed anew for
each shot, so one may come or go; a picture without width or height is left
out.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_NAME = re.compile(r"(\d+)-(\d+)\.png")
SCHEMA = "shot long, monitor int, width int, height int, image binary"


def shots(folder: str) -> dict[int, list[tuple[int, Path]]]:
    """Monitors and their files by shot, both in order."""
    found: dict[int, list[tuple[int, Path]]] = {}
    for path in Path(folder).iterdir():
        if m := _NAME.fullmatch(path.name):
            found.setdefault(int(m[1]), []).append((int(m[2]), path))
    return {k: sorted(found[k]) for k in sorted(found)}


def grabbed(shot: int, monitors: list[tuple[int, Path]]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Rows of one shot; a PNG's size stands in its header."""
    for monitor, path in monitors:
        image = path.read_bytes()
        if len(image) < 24 or image[:8] != b"\x89PNG\r\n\x1a\n":
            continue
        width, height = struct.unpack(">II", image[16:24])
        if width and height:
            yield shot, monitor, width, height, image


class _Shots(InputPartition):
    """Shots with their monitors' files: a task opens these and lists nothing."""

    def __init__(self, found: dict[int, list[tuple[int, Path]]]) -> None:
        self.shots = [(k, [(monitor, str(path)) for monitor, path in monitors]) for k, monitors in found.items()]


def _parted(found: dict[int, list[tuple[int, Path]]], most: int) -> list[_Shots]:
    names = list(found)
    return [_Shots({k: found[k] for k in names[i : i + most]}) for i in range(0, len(names), most)]


def _read(partition: _Shots) -> Iterator[tuple]:
    for shot, monitors in partition.shots:
        yield from grabbed(shot, [(monitor, Path(path)) for monitor, path in monitors])


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def partitions(self) -> list[_Shots]:
        return _parted(shots(self.folder), self.most) or [_Shots({})]

    def read(self, partition: _Shots) -> Iterator[tuple]:
        return _read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of shots.  The driver lists names alone; images are read in tasks."""

    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"shot": -1}

    def latestOffset(self) -> dict:
        return {"shot": max(shots(self.folder), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Shots]:
        return _parted({k: m for k, m in shots(self.folder).items() if start["shot"] < k <= end["shot"]}, self.most)

    def read(self, partition: _Shots) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        """Shots stay where they are."""


class ScreenSource(DataSource):
    """Options: ``path``, a folder that driver and executors share; ``shots``, most shots of a task."""

    @classmethod
    def name(cls) -> str:
        return "screen"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("shots", "10")))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("shots", "10")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScreenSource)
