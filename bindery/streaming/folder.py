"""A folder as a stream: listings as offsets, and files that have settled.

``FolderSightings`` is a streaming source whose offsets number listings of a folder. A listing
is written, whole and once, before its number is an offset, so a batch that is run again, also
after a restart, reads what it read. ``settled`` keeps a state by path: a file is told when it
has looked the same in so many listings in a row, once for its mark and once more for each UTC
day that finds it still there (those that had to wait, and were not taken away). Two timers go
with the state: at the next UTC midnight a file that was told is to be told again; and a path
that no listing has any more is forgotten.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from bindery.sources import files

SIGHTINGS = "listing long, path string, mark string, at timestamp"
STATE = "mark string, streak long, told string, rearm long, forget long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def listed(folder: str) -> list[tuple[str, str]]:
    """(path, mark) of the files below a folder, as ``files.listing`` names and marks them."""
    from pyarrow import fs

    system, root = files._opened(folder)
    scheme = "file:" if system.type_name == "local" else folder[: folder.index("://") + 3] + folder.split("://", 1)[1].partition("/")[0]
    told = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    plain = (i for i in told if i.type == fs.FileType.File)
    return sorted((scheme + ("" if i.path.startswith("/") else "/") + i.path, f"{i.size}:{i.mtime_ns // 1_000_000 * 1000}") for i in plain)


class _Listing(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, log: str):
        self.folder, self.log = folder, log
        self.system, self.root = files._opened(log)
        self.system.create_dir(self.root, recursive=True)

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        names = (i.base_name for i in self.system.get_file_info(fs.FileSelector(self.root)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _at(self, number: int) -> str:
        return f"{self.root}/{number:012d}.json"

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        """A new listing, written before it has a number."""
        number = (self._numbers() or [-1])[-1] + 1
        now = time.time_ns() // 1000
        aside = f"{self.root}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(aside) as out:
            out.write(json.dumps({"at": now, "files": listed(self.folder)}).encode())
        self.system.move(aside, self._at(number))
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Listing(n) for n in range(start["listing"] + 1, end["listing"] + 1)]

    def read(self, partition: _Listing) -> Iterator[tuple]:
        with self.system.open_input_stream(self._at(partition.number)) as held:
            told = json.loads(held.read())
        at = dt.datetime.fromtimestamp(told["at"] / 1e6, dt.UTC)
        for path, mark in told["files"]:
            yield partition.number, path, mark, at

    def commit(self, end: dict) -> None:
        """Listings before the last one of a finished batch are read no more."""
        for number in self._numbers():
            if number < end["listing"]:
                self.system.delete_file(self._at(number))


class FolderSightings(DataSource):
    """Options: ``path``, the folder, and ``log``, where its listings are written."""

    @classmethod
    def name(cls) -> str:
        return "folder_sightings"

    def schema(self) -> str:
        return SIGHTINGS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options["log"])


def step(state: tuple | None, seen: Iterable[tuple[str, str]], checks: int) -> tuple[tuple, list[str]]:
    """(mark, streak, told) after sightings (mark, UTC day) of a path, and the marks to tell."""
    mark, streak, told = state or (None, 0, "")
    out = []
    for now, day in seen:
        streak, told = (streak + 1, told) if now == mark else (1, "")
        mark = now
        if streak >= checks and told != day:
            out.append(mark)
            told = day
    return (mark, streak, told), out


def midnight(milliseconds: int) -> int:
    """The next UTC midnight."""
    day = 86_400_000
    return (milliseconds // day + 1) * day


class Settling(StatefulProcessor):
    """The state of a path, with its timers."""

    def __init__(self, checks: int, forget: int):
        self.checks, self.forget = checks, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("listing", kind="stable")
        days = pd.to_datetime(seen["at"], utc=True).dt.strftime("%Y-%m-%d")
        before = self.state.get() if self.state.exists() else None
        rearm, forget = (before[3], before[4]) if before else (0, 0)
        (mark, streak, told), out = step(tuple(before[:3]) if before else None, zip(seen["mark"], days), self.checks)
        now = timerValues.getCurrentProcessingTimeInMs()
        if forget:
            self.handle.deleteTimer(forget)
        forget = now + self.forget
        self.handle.registerTimer(forget)
        if out and rearm != midnight(now):
            rearm = midnight(now)
            self.handle.registerTimer(rearm)
        self.state.update((mark, streak, told, rearm, forget))
        if out:
            yield pd.DataFrame({"path": [key[0]], "mark": [out[-1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists():
            mark, streak, told, rearm, forget = self.state.get()
            if due == forget:
                self.state.clear()
                if rearm > due:
                    self.handle.deleteTimer(rearm)
            elif due == rearm:
                self.state.update((mark, streak, "", 0, forget))
        yield from ()

    def close(self) -> None:
        pass


def settled(sightings: DataFrame, checks: int = 2, forget_after: float = 60.0) -> DataFrame:
    """(path, mark) of a stream of sightings; ``forget_after`` in seconds."""
    grouped = sightings.groupBy("path")
    return grouped.transformWithStateInPandas(Settling(checks, int(forget_after * 1000)), "path string, mark string", "Append", "ProcessingTime")


def watch(
    spark: SparkSession, folder: str, root: str, handle: Callable[[DataFrame, int], None], checks: int = 2, every: float = 5.0, forget_after: float | None = None
) -> StreamingQuery:
    """Start the stream of a folder's settled files; below ``root`` are its listings and its
    progress, from which it goes on after a restart. ``handle`` gets (path, mark) and the
    number of each batch; a batch that was not finished is handled again."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.dataSource.register(FolderSightings)
    sightings = spark.readStream.format("folder_sightings").option("path", folder).option("log", f"{root.rstrip('/')}/listings").load()
    ready = settled(sightings, checks, forget_after or max(60.0, 12 * every))
    trigger = {"processingTime": f"{every} seconds"}
    return ready.writeStream.trigger(**trigger).option("checkpointLocation", f"{root.rstrip('/')}/progress").foreachBatch(handle).start()
