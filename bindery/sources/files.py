"""Files in and out: listings with their marks, and whole files put into folders.

Listings come from Spark's ``binaryFile`` source without reading contents. Files are written
by the executors, a row at a time, under a hidden name that no library watches, then renamed:
a reader sees a file whole or not at all, and a task that is run again puts the same bytes in
the same place. Folders are URIs or paths that all executors share.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.storage import read_text

HALF_WRITTEN = "bindery-tmp"
#: Bytes of a file that are held while it is digested.
PIECE = 1 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length, modificationTime, mark) of all files below ``root``, by name;
    ``mark`` changes whenever size or time of a file does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    mark = F.concat_ws(":", "length", F.unix_micros("modificationTime"))
    return files.select(
        "path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", "modificationTime", mark.alias("mark")
    ).orderBy("path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, content) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def at_top(listed: DataFrame, root: str) -> DataFrame:
    """The listed files that are in ``root`` itself."""
    plain = lambda uri: re.sub("^file:/*", "/", uri.rstrip("/"))
    return listed.filter(F.regexp_replace("path", "^file:/*", "/") == F.concat(F.lit(f"{plain(root)}/"), "name"))


def read(paths: DataFrame) -> DataFrame:
    """(path, ...) -> (path, name, content) of the files that are there: no others are opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                system, path = _opened(uri)
                try:
                    with system.open_input_stream(path) as held:
                        yield pd.DataFrame({"path": [uri], "name": [uri.rpartition("/")[2]], "content": [held.read()]})
                except FileNotFoundError:
                    continue

    return paths.select("path").mapInPandas(run, "path string, name string, content binary")


def digests(paths: DataFrame) -> DataFrame:
    """(path) -> (path, digest): SHA-256 of each file, read in pieces; null where it is gone."""

    def digest(uri: str) -> str | None:
        system, path = _opened(uri)
        told = hashlib.sha256()
        try:
            with system.open_input_stream(path) as held:
                while piece := held.read(PIECE):
                    told.update(piece)
        except FileNotFoundError:
            return None
        return told.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "digest": [digest(uri) for uri in batch["path"]]})

    return paths.select("path").mapInPandas(run, "path string, digest string")


def _opened(uri: str):
    """The file system of a URI or path, and the path there; names are taken as they are, as
    they may hold what a URI would encode."""
    from pyarrow import fs

    scheme, authority, path = re.fullmatch(r"(?:(\w+):)?(?://([^/]*))?(.*)", uri, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    system, probe = fs.FileSystem.from_uri(f"{scheme}://{authority}/x")
    return system, probe[:-1] + path.lstrip("/")


def put(uri: str, content: bytes) -> None:
    """Write one file under a hidden name, then rename it."""
    system, path = _opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.{HALF_WRITTEN}"
    with system.open_output_stream(aside) as out:
        out.write(content)
    if system.type_name == "local":
        with open(aside, "rb") as written:
            os.fsync(written.fileno())
    system.move(aside, path)


def place(rows: DataFrame, folder: str) -> DataFrame:
    """(name, content) -> (name, error): each row's file in ``folder``; error is null if it
    arrived. A name is written by one row only, see ``free_names``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    put(f"{folder.rstrip('/')}/{name}", content)
                    told.append((name, None))
                except OSError as error:
                    told.append((name, str(error)))
            yield pd.DataFrame(told, columns=["name", "error"])

    return rows.select("name", "content").mapInPandas(run, "name string, error string")


def delete(paths: DataFrame) -> DataFrame:
    """(path) -> (path, error): the files gone; one that is not there is gone already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for uri in batch["path"]:
                try:
                    system, path = _opened(uri)
                    system.delete_file(path)
                    told.append((uri, None))
                except FileNotFoundError:
                    told.append((uri, None))
                except OSError as error:
                    told.append((uri, str(error)))
            yield pd.DataFrame(told, columns=["path", "error"])

    return paths.select("path").mapInPandas(run, "path string, error string")


def remove_empty_folders(root: str) -> None:
    """Take out the folders below ``root`` that have nothing in them, the deepest first."""
    from pyarrow import fs

    system, path = _opened(root)
    below = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    folders = sorted((f.path for f in below if f.type == fs.FileType.Directory), key=len, reverse=True)
    full = {f.path.rpartition("/")[0] for f in below if f.type != fs.FileType.Directory}
    for folder in folders:
        if folder in full:
            full.add(folder.rpartition("/")[0])
        else:
            system.delete_dir(folder)


def bare_secret(text: str | None) -> str | None:
    """A secret file's text without the word before a bearer's; None if nothing is left."""
    text = (text or "").strip()
    word, _, rest = text.partition(" ")
    return (rest.strip() if word.lower() == "bearer" else text) or None


def secret(spark: SparkSession, path: str) -> str | None:
    """The secret that a file holds; None for no file and for an empty one. It is for the driver
    alone and never put into a plan."""
    return bare_secret(read_text(spark, path))
