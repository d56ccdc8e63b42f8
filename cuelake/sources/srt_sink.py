"""A sink of SRT files, one an episode, named by it: all of a run's files appear, or none does.

Tasks write into a folder of the run's own below the target, row by row. The driver moves the files of the
tasks that count into place once every task has succeeded, and removes the folder in either case; what a
failed or repeated attempt has written is never moved.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .srt import block


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SrtWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.run = f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows (ep, block) of whole episodes, in order."""
        system, root = file_system(self.path)
        folder = posixpath.join(root, self.run)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        now, out = None, None
        try:
            for ep, text in iterator:
                if ep != now:
                    if out:
                        out.close()
                    if not re.fullmatch(r"[^/\\\x00]+", ep or "") or ep in (".", "..") or ep.startswith("_run-"):
                        raise ValueError(f"an episode's name that cannot be a file's: {ep!r}")
                    if any(ep == done for done, _ in files):
                        raise ValueError(f"rows of an episode that do not stand together: {ep!r}")
                    files.append((ep, posixpath.join(folder, uuid.uuid4().hex)))
                    out, now = system.open_output_stream(files[-1][1]), ep
                else:
                    out.write(b"\n\n")
                out.write(text.encode())
            if out:
                out.write(b"")
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        names = [ep for ep, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an episode's rows stood in several tasks")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            keep = set(names)
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.extension == "srt" and old.base_name[:-4] not in keep:
                    system.delete_file(old.path)
        for ep, file in files:
            system.move(file, posixpath.join(root, f"{ep}.srt"))
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        folder = posixpath.join(root, self.run)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class SrtFiles(DataSource):
    """``srtfiles``: the sink. Append replaces the episodes that are written; overwrite removes the others."""

    @classmethod
    def name(cls) -> str:
        return "srtfiles"

    def schema(self) -> str:
        return "ep string, block string"

    def writer(self, schema, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options, overwrite)


def write_srt_files(cues: DataFrame, path: str, mode: str = "append") -> None:
    """K1: ``path/<ep>.srt`` for every episode of (ep, cue_id, start_ms, end_ms, text): by time, renumbered from 1.

    A cue without text, or without a time, ends the run, which then leaves nothing.
    """
    spark = SparkSession.active()
    spark.dataSource.register(SrtFiles)
    n = F.row_number().over(Window.partitionBy("ep").orderBy("start_ms", "end_ms", "cue_id"))
    lacks = ~F.coalesce("text", F.lit("")).rlike(r"\S") | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    refused = F.raise_error(F.concat(F.lit("a cue without text or times: "), F.coalesce(F.col("cue_id").cast("string"), F.lit("null"))))
    text = F.when(lacks, refused).otherwise(F.col("text"))
    rows = cues.select(F.col("ep").cast("string").alias("ep"), "cue_id", "start_ms", "end_ms", text.alias("text")).withColumn("n", n)
    rows = rows.repartition("ep").sortWithinPartitions("ep", "n").select("ep", block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("block"))
    rows.write.format("srtfiles").mode(mode).save(path)
