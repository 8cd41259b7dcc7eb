"""The journal of a run: numbered entries written once each, from which readers take one state of the folder."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = "_attempt"


@dataclass(frozen=True)
class Entry:
    """What a run did: it began ``attempt`` of ``epoch``, or finished ``chunk`` of it.

    ``batches`` says that the attempt's tasks commit their rows one by one, so that rows of a chunk count before its end.
    """

    epoch: int
    attempt: int
    state: str  # "begun" or "finished"
    chunk: int = -1
    chunks: int = 1
    batches: bool = False

    def folder(self, chunk: int) -> str:
        return f"rows-{self.attempt:010d}-{chunk}"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of that name: of several writers exactly one gets true.

    The text goes to a draft beside it, and the draft gets the name: by a hard link on file systems of the operating
    system, by a rename that does not overwrite on others.
    """
    jvm = spark._jvm
    target, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{os.path.dirname(path)}/_draft-{uuid.uuid4().hex}"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if system.getUri().getScheme() == "file":
        here, there = draft.toUri().getPath(), target.toUri().getPath()
        with open(here, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.remove(here)
        return True
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(draft, target, spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as failure:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(getattr(failure, "java_exception", failure)):
            return False
        raise
    return True


class Journal:
    """Entries ``journal/00000000.json`` and so on below a run's folder. Rows stand in folders that entries name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> list[Entry]:
        """All entries, in order: what a reader sees is fixed by one call."""
        try:
            files = self.spark.read.option("wholetext", "true").text(f"{self.path}/journal")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        rows = files.select(F.col("_metadata.file_name").alias("name"), "value").collect()  # one small row an entry
        known = {f.name for f in fields(Entry)}
        return [Entry(**{k: v for k, v in json.loads(r["value"]).items() if k in known}) for r in sorted(rows)]

    def append(self, make: Callable[[list[Entry]], Entry]) -> Entry:
        """Add the entry that ``make`` derives from the entries before it; it is made anew if another run was quicker."""
        while True:
            before = self.entries()
            entry = make(before)
            if put_if_absent(self.spark, f"{self.path}/journal/{len(before):08d}.json", json.dumps(asdict(entry))):
                return entry

    def begin(self, resume: bool, chunks: int, batches: bool) -> Entry:
        """Take the next attempt number. Without ``resume``, or at first, it begins a new epoch."""

        def next_attempt(before: list[Entry]) -> Entry:
            epoch = max((e.epoch for e in before), default=-1)
            number = max((e.attempt for e in before), default=0) + 1
            return Entry(epoch if resume and before else epoch + 1, number, "begun", chunks=chunks, batches=batches)

        return self.append(next_attempt)

    def finish(self, begun: Entry, chunk: int) -> Entry:
        return self.append(lambda _: Entry(begun.epoch, begun.attempt, "finished", chunk, begun.chunks, begun.batches))

    def rows(self, entries: Sequence[Entry], before: Entry | None = None) -> DataFrame | None:
        """Rows of the latest epoch among ``entries``, with the attempt they belong to; None where there are none.

        A chunk that is not finished counts only where its tasks commit by themselves, and then with the rows committed
        when this is called. Of a file system only folders that entries name are read. ``before`` leaves out an attempt.
        """
        latest = max((e.epoch for e in entries), default=None)
        live = [e for e in entries if e.epoch == latest and (before is None or e.attempt != before.attempt)]
        folders = {e.folder(e.chunk) for e in live if e.state == "finished"}
        folders |= {e.folder(c) for e in live if e.state == "begun" and e.batches for c in range(e.chunks)}
        there = [f"{self.path}/{f}" for f in sorted(folders) if self._has_rows(f)]
        if not there:
            return None
        attempt = F.regexp_extract(F.col("_metadata.file_path"), r"/rows-(\d+)-\d+/[^/]+$", 1).cast("long")
        return self.spark.read.parquet(*there).select("*", attempt.alias(ATTEMPT))

    def _has_rows(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return False
        return any(not f.getPath().getName().startswith(("_", ".")) for f in system.listStatus(path))
