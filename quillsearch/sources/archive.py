"""Article archives: gzip-compressed tar files of concatenated JSON values."""

from __future__ import annotations

import codecs
import json
import logging
import os
import tarfile
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.html import sectioned
from ..schema import INPUT

log = logging.getLogger(__name__)
LINES = "archive string, member string, line long, value string"


#: Characters of a member that are decoded at a time.
CHUNK = 1 << 20


def members(data) -> Iterator[tuple[str, Iterator[str]]]:
    """Names of an archive's regular members, and their texts in chunks, as they come.

    One that can't be read on is logged and ends there; the others follow."""

    def chunks(name: str, file) -> Iterator[str]:
        decoder = codecs.getincrementaldecoder("utf-8")()
        try:
            while data := file.read(CHUNK):
                yield decoder.decode(data)
            yield decoder.decode(b"", True)
        except (OSError, UnicodeDecodeError, tarfile.TarError) as error:
            log.warning("member %s: %s", name, error)

    with tarfile.open(fileobj=data, mode="r|gz") as tar:
        for info in tar:
            if info.isfile():
                yield info.name, chunks(info.name, tar.extractfile(info))


def values(text: str | Iterator[str]) -> Iterator[str]:
    """Concatenated JSON values; the first that is broken ends the member.

    No more of the text is held than the value that is being read, and a chunk."""
    decoder = json.JSONDecoder()
    chunks = iter([text] if isinstance(text, str) else text)
    held, at, more = "", 0, True
    while True:
        while at < len(held) and held[at] in " \t\r\n":
            at += 1
        try:
            end = decoder.raw_decode(held, at)[1] if at < len(held) else -1
            broken = None
        except ValueError as error:
            end, broken = -1, error
        if end >= 0 and (end < len(held) or not more):
            yield held[at:end]
            at = end
            continue
        if not more:
            if broken:
                log.warning("a member ends early: %s", broken)
            return
        # the value may go on: read as much again, so that long values cost little more
        held, at = held[at:], 0
        size, parts = 0, []
        while more and size <= len(held):
            part = next(chunks, None)
            more = part is not None
            if more:
                parts.append(part)
                size += len(part)
        held += "".join(parts)


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        from glob import glob

        self.paths = sorted(p for part in options["path"].split(",") for p in ([part] if "://" in part else glob(part) or [part]))

    def partitions(self):
        return [ArchivePartition(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        if "://" in partition.path:
            files, at = fs.FileSystem.from_uri(partition.path)
        else:
            files, at = fs.LocalFileSystem(), os.path.abspath(partition.path)
        with files.open_input_stream(at, compression=None) as f:
            for name, text in members(f):
                for line, value in enumerate(values(text)):
                    yield partition.path, name, line, value


class ArchiveSource(DataSource):
    """``spark.read.format("article_archive")``: a partition per archive, a row per JSON value.

    Paths are plain or URIs of a shared file system.  An archive is one compressed
    stream, so one task reads it, but never holds more than a value and a chunk of it."""

    @classmethod
    def name(cls):
        return "article_archive"

    def schema(self):
        return LINES

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The JSON values of archives, local or shared; several paths are parted by commas."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("article_archive").option("path", path).load()


def download(url: str, out, chunk: int = 1 << 20) -> int:
    """Stream a URL into an open file; anything but status 200 is an error.  Returns the bytes."""
    done = 0
    with urllib.request.urlopen(url, timeout=60) as response:  # noqa: S310
        if response.status != 200:
            raise OSError(f"{url}: status {response.status}")
        while data := response.read(chunk):
            out.write(data)
            done += len(data)
            log.info("%s: %d bytes", url, done)
    return done


def from_lines(lines: DataFrame) -> DataFrame:
    """JSON-lines rows (archive, member, line, value) whose broken lines are still there:
    the first broken line of a member ends it."""
    parsed = lines.withColumn("record", F.from_json("value", INPUT)).withColumn("broken", F.get_json_object("value", "$").isNull())
    bad = F.min(F.when(F.col("broken"), F.col("line"))).over(Window.partitionBy("archive", "member"))
    return parsed.withColumn("bad", bad).where(F.col("bad").isNull() | (F.col("line") < F.col("bad"))).drop("bad", "broken")


def articles(lines: DataFrame) -> DataFrame:
    """id, title, entity, html and where each record stood; empty pages are left out."""
    r = F.coalesce(F.col("record"), F.from_json("value", INPUT)) if "record" in lines.columns else F.from_json("value", INPUT)
    out = lines.withColumn("r", r).select(
        F.coalesce("r.identifier", F.lit(0)).alias("id"), F.coalesce("r.name", F.lit("")).alias("title"), F.coalesce("r.main_entity.identifier", F.lit("")).alias("entity"),
        F.coalesce("r.article_body.html", F.lit("")).alias("html"), "archive", "member", "line",
    )
    return out.where(F.length("html") > 0)


def with_sections(pages: DataFrame) -> DataFrame:
    """Adds ``items``; pages without any section are left out."""
    return pages.withColumn("items", sectioned("html")).drop("html").where(F.size("items") > 0)
