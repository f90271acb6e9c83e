"""A streaming source of growing JSON-lines files by byte position.

An offset holds, for each file, how many bytes are taken and the SHA-256 of those bytes. A batch is the complete lines behind them; a line
that is still being written waits. Each task hashes what its file held before and raises if that was rewritten, so a changed past is an error
and never a silent gap; a file that shrank is one too. The driver hashes new bytes only; after a restart, each file once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 20
SCHEMA = "file string, byte_start long, byte_end long, line string"


class Rewritten(ValueError):
    """A file no longer begins with the bytes that were taken from it."""


@dataclass
class Increment(InputPartition):
    file: str
    start: int
    end: int
    mark: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _hashed(stream, end: int, digest) -> None:
    """Adds the next `end` bytes of the stream to the digest; fails if it ends before them."""
    while end:
        data = stream.read(min(CHUNK, end))
        if not data:
            raise Rewritten("TRANSCRIPT_REWRITTEN: shorter than what was taken")
        digest.update(data)
        end -= len(data)


class GrowingLines(DataSource):
    """Options: `path` (a folder, or a folder's URI), `suffix` (default .jsonl), `lineBytes` (longer lines come without their text),
    `batchBytes` (of one file in one batch, whole lines; a longer line makes a batch of its own)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.line_bytes, self.batch_bytes = int(options.get("lineBytes", 2 << 20)), int(options.get("batchBytes", 64 << 20))
        self.digests: dict = {}
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _after(self, stream, start: int, size: int, most: int) -> int:
        """Where the last complete line of the next batch ends, of about `most` bytes."""
        stream.seek(start)
        at, last = start, start
        while at < size and (at - start < most or last == start):
            data = stream.read(min(CHUNK, size - at))
            if not data:
                break
            cut = data.rfind(b"\n")
            last = at + cut + 1 if cut >= 0 else last
            at += len(data)
        return last

    def latestOffset(self) -> dict:
        found = {}
        where, folder = _opened(self.path)
        for info in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if not info.is_file or not info.path.endswith(self.suffix):
                continue
            start, digest = self.digests.get(info.path, (0, hashlib.sha256()))
            if info.size < start:
                raise Rewritten(f"TRANSCRIPT_REWRITTEN: {info.path} shrank")
            with where.open_input_file(info.path) as stream:
                # what a checkpoint has taken of a file is not known here, so its first batch in this reader is not bounded
                end = self._after(stream, start, info.size, self.batch_bytes if info.path in self.digests else info.size)
                stream.seek(start)
                _hashed(stream, end - start, digest)
            self.digests[info.path] = (end, digest)
            found[info.path] = [end, digest.hexdigest()]
        if self.now and (gone := set(self.now) - set(found)):
            raise Rewritten(f"TRANSCRIPT_REWRITTEN: {sorted(gone)[0]} is gone")
        self.now = found
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, (last, mark) in sorted(end.items()):
            first, before = start.get(path, [0, ""])
            if last < first:
                raise Rewritten(f"TRANSCRIPT_REWRITTEN: {path} shrank")
            if last > first or mark != before:
                parts.append(Increment(path, first, last, before))
        return parts

    def read(self, partition: Increment) -> Iterator[tuple]:
        where, _ = _opened(self.path)
        digest = hashlib.sha256()
        with where.open_input_file(partition.file) as stream:
            _hashed(stream, partition.start, digest)
            if partition.start and digest.hexdigest() != partition.mark:
                raise Rewritten(f"TRANSCRIPT_REWRITTEN: {partition.file}")
            at, held, begin = partition.start, [], partition.start
            while at < partition.end:
                data = stream.read(min(CHUNK, partition.end - at))
                if not data:
                    raise Rewritten(f"TRANSCRIPT_REWRITTEN: {partition.file} shrank while it was read")
                for piece in _lines(data):
                    held.append(piece)
                    at += len(piece)
                    if piece.endswith(b"\n"):
                        size = at - begin
                        text = None if size > self.line_bytes else b"".join(held).rstrip(b"\n").decode("utf-8", "replace")
                        yield (partition.file, begin, at, text)
                        held, begin = [], at
                    elif at - begin > self.line_bytes:
                        held = []  # too long to be given; its bytes still count


def _lines(data: bytes) -> list[bytes]:
    """The lines of some bytes, cut at line feeds only."""
    parts = data.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of (file, byte_start, byte_end, line) of the files in `path`; a null line was longer than `lineBytes`."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(path=path, **options).load()


def transcript_rows(lines: DataFrame) -> DataFrame:
    """(file, byte_start, byte_end, role, content) of lines in either dialect: text blocks joined by line ends, roles as `readers.transcript`
    names them. Lines of other kinds have a null content and the role `other`, over-long ones `oversized`: they are seen, not lost."""
    pick = lambda *paths: F.coalesce(*[F.get_json_object("line", p) for p in paths])
    role = F.lower(pick("$.role", "$.message.role", "$.payload.role", "$.type"))
    known = F.when(role.isin("human", "user"), "user").when(role.isin("assistant", "ai", "model"), "assistant").when(role.isin("system", "developer"), "system")
    raw = pick("$.message.content", "$.content", "$.payload.content", "$.text")
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    texts = F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull())
    content = F.when(F.startswith(raw, F.lit("[")), F.nullif(F.array_join(F.transform(texts, lambda b: b["text"]), "\n"), F.lit(""))).otherwise(raw)
    kind = F.when(F.col("line").isNull(), "oversized").when(pick("$.isCompactSummary") == "true", "summary").when(pick("$.isMeta") == "true", "system").when(content.isNull(), "other").otherwise(F.coalesce(known, F.lit("other")))
    return lines.select("file", "byte_start", "byte_end", kind.alias("role"), F.when(kind != "other", content).alias("content"))


def offsets_of(progress: str) -> dict[str, int]:
    """The bytes taken of each file, from a query's offset as JSON."""
    return {path: end for path, (end, _) in json.loads(progress).items()}
