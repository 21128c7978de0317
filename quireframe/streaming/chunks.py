"""Ordered chunks as a stream: a source whose offset is the sequence, revisions that are newer, and snapshots that stay when a chunk fails."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

NAME = "quire_chunks"


def write_chunks(rows: DataFrame, folder: str, sequence: str, files: int) -> None:
    """Rows as chunk files 00000000.parquet and so on, in the order of their sequence, as many rows in each as the next.

    Tasks write them: rows are dealt by their file's number, so a task holds a file's rows at most.
    """
    from pyarrow import fs
    from pyarrow import parquet

    most = rows.agg(F.max(sequence)).first()[0]
    per_file = max(1, -(-((most if most is not None else -1) + 1) // files))
    schema = to_arrow_schema(rows.schema)

    def write(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        system.create_dir(at, recursive=True)
        table = pa.Table.from_pandas(chunk.sort_values(sequence)[rows_columns], schema=schema, preserve_index=False)
        parquet.write_table(table, f"{at}/{key[0]:08d}.parquet", filesystem=system)
        return pd.DataFrame({"n": [len(chunk)]})

    rows_columns = rows.columns
    rows.groupBy(F.floor(F.col(sequence) / per_file).cast("long").alias("_file")).applyInPandas(write, "n long").agg(F.sum("n")).first()


@dataclass
class Chunk(InputPartition):
    number: int


class ChunkReader(DataSourceStreamReader):
    """Offsets are numbers of chunks: what is there up to the first gap can be read; each chunk is a partition."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.now = path, schema.names, 0

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", self.path))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """The chunks that can be read by now; one that is not there holds back those behind it."""
        from pyarrow import fs

        system, at = self._store()
        there = {int(m[1]) for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if (m := re.fullmatch(r"([0-9]+)\.parquet", i.base_name))}
        while self.now in there:
            self.now += 1
        return {"next": self.now}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        self.now = max(self.now, end["next"])
        return [Chunk(n) for n in range(start["next"], end["next"])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        system, at = self._store()
        with system.open_input_file(f"{at}/{partition.number:08d}.parquet") as source:
            yield from parquet.ParquetFile(source).iter_batches(columns=self.names)

    def commit(self, end: dict) -> None:
        """Chunks stay where they are, so that a batch can run again."""


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], schema)


def chunks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The chunks of a folder as a stream, in order of their numbers; a batch has all that are there by then."""
    spark.dataSource.register(ChunkSource)
    return spark.readStream.format(NAME).schema(schema).load(path)


class Newer(StatefulProcessor):
    """Lets a row pass whose revision is above all that its key has had."""

    def __init__(self, revision: str, columns: list[str]):
        self.revision, self.columns = revision, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        whole = pd.concat(list(rows)).sort_values(self.revision, kind="stable")
        whole = whole[~whole[self.revision].duplicated()]
        if last is not None:
            whole = whole[whole[self.revision] > last]
        if len(whole):
            self.last.update((int(whole[self.revision].iloc[-1]),))
        yield whole[self.columns]

    def close(self) -> None:
        pass


def newer(stream: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The rows that are newer than what their key had when their batch came; stale and repeated revisions are dropped.

    Within a batch rows go by revision. Appended to a table they are its history, whose newest rows are the current ones.
    """
    return stream.groupBy(*keys).transformWithStateInPandas(Newer(revision, stream.columns), stream.schema, "Append", "None")


STATE = "parts long, rows long, status string, upto long"
SNAPSHOT = "sequence long, parts long, rows long, status string"


class Snapshots(StatefulProcessor):
    """What a document shows after each of its chunks that changes it, until one fails or says that it is whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, count, status, upto = self.state.get() if self.state.exists() else (0, 0, "loading", -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("sequence").itertuples(index=False):
            if status != "loading" or r.sequence <= upto:
                continue
            upto = int(r.sequence)
            if r.kind == "error":
                status = "partial" if parts else "failed"
            elif r.kind == "complete":
                status = "complete"
            elif r.kind == "part":
                parts, count = parts + 1, count + int(r.rows)
            else:
                continue
            out.append((*key, upto, parts, count, status))
        self.state.update((parts, count, status, upto))
        yield pd.DataFrame(out, columns=[self.key, *(x.split()[0] for x in SNAPSHOT.split(", "))])

    def __init__(self, key: str):
        self.key = key

    def close(self) -> None:
        pass


def snapshots(stream: DataFrame, key: str) -> DataFrame:
    """(key, sequence, parts, rows, status): a snapshot for each chunk (key, sequence, kind, rows) that changes a document.

    kind is 'part' (rows more), 'complete', 'error' or another, which changes nothing. After an error what has come stays
    as 'partial' ('failed' if nothing has), and later chunks are passed over, as they are after 'complete'. Chunks of a
    document have to come in order, as chunks() gives them; within a batch they are sorted.
    """
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(Snapshots(key), f"{key} {kind}, {SNAPSHOT}", "Append", "None")
