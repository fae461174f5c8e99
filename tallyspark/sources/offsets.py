"""A Python data source over ``Log``: a batch or a stream whose offsets are (partition, offset).

    spark.dataSource.register(OffsetLog)
    spark.readStream.format("offset_log").option("path", ...).load()

Options: ``path``; ``startingOffsets`` and, in a batch, ``endingOffsets`` (``earliest``,
``latest`` or ``{"0": 12, ...}``); in a stream ``maxOffsetsPerTrigger``, shared over the
partitions by what each has in arrears, with ``checkpoint``, the query's checkpoint
folder: the next bound counts from the last planned batch there, also after a restart;
``failOnDataLoss`` (true): whether offsets that retention has dropped are an error.

Planning reads the commits alone, tasks read the row groups that reach into their range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import RECORD
from .commits import State, state_of
from .log import log_ranges


def opened(uri: str) -> tuple[pf.FileSystem, str]:
    """File system and path of a URI or of a local path."""
    return pf.FileSystem.from_uri(uri) if ":/" in uri else (pf.LocalFileSystem(), uri)


def children(fs: pf.FileSystem, path: str) -> list[str]:
    return [i.path for i in fs.get_file_info(pf.FileSelector(path, allow_not_found=True)) if i.type == pf.FileType.File]


def text_of(fs: pf.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as stream:
        return stream.read().decode()


class Piece(InputPartition):
    """The offsets from ``start`` to ``end`` of one file."""

    def __init__(self, path: str, partition: int, start: int, end: int):
        self.path, self.partition, self.start, self.end = path, partition, start, end


class Pieces:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.starting, self.ending = options.get("startingOffsets", "earliest"), options.get("endingOffsets", "latest")
        self.strict = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.most = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        self.checkpoint = options.get("checkpoint", "").rstrip("/")
        if self.most is not None and (self.most < 1 or not self.checkpoint):
            raise ValueError("maxOffsetsPerTrigger is at least 1 and needs the checkpoint option")

    def state(self) -> State:
        fs, path = opened(self.path)
        state = state_of([p.rsplit("/", 1)[-1] for p in children(fs, f"{path}/commits")], lambda name: text_of(fs, f"{path}/commits/{name}"))
        if not state.marks:
            raise ValueError(f"{self.path}: the log has no partitions")
        return state

    def resolved(self, asked: str, state: State) -> dict[str, int]:
        """Offsets by partition; partitions that a JSON text leaves out are at their start."""
        ranges = {str(p): (start, end) for p, start, end in log_ranges(state)}
        if asked in ("earliest", "latest"):
            return {p: r[asked == "latest"] for p, r in ranges.items()}
        given = {str(p): int(o) for p, o in json.loads(asked).items()}
        if unknown := sorted(given.keys() - ranges.keys()):
            raise ValueError(f"{self.path}: no partition {', '.join(unknown)}")
        return {p: given.get(p, r[0]) for p, r in ranges.items()}

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        state, out = self.state(), []
        fs, root = opened(self.path)
        for p, first, _ in log_ranges(state):
            lo, hi = start.get(str(p), 0), end.get(str(p), 0)
            if lo < min(first, hi) and self.strict:
                raise ValueError(f"{self.path}: offsets {lo} to {min(first, hi)} of partition {p} are gone")
            for e in state.entries.values():
                if e["partition"] == p and e["first"] < hi and e["next"] > lo:
                    out += [Piece(f, p, max(lo, e["first"]), min(hi, e["next"])) for f in sorted(children(fs, f"{root}/{e['path']}")) if f.endswith(".parquet")]
        return out

    def records(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(RECORD)
        names = [n for n in RECORD.names if n != "partition"]
        with opened(self.path)[0].open_input_file(piece.path) as source:
            file = pq.ParquetFile(source)
            column = next(c for c in range(file.metadata.num_columns) if file.metadata.schema.column(c).path == "offset")
            groups = []
            for g in range(file.num_row_groups):
                s = file.metadata.row_group(g).column(column).statistics
                if s is None or not s.has_min_max or (s.min < piece.end and s.max >= piece.start):
                    groups.append(g)
            for batch in file.iter_batches(batch_size=8192, row_groups=groups, columns=names):
                offset = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(offset, piece.start), pc.less(offset, piece.end)))
                if batch.num_rows:
                    whole = {n: batch.column(n) for n in names} | {"partition": pa.array([piece.partition] * batch.num_rows, pa.int32())}
                    yield pa.RecordBatch.from_arrays([utc(whole[f.name]).cast(f.type) for f in schema], schema=schema)


def utc(column: pa.Array) -> pa.Array:
    """Times without a zone, as some parquet types give them, are in UTC."""
    return pc.assume_timezone(column, "UTC") if pa.types.is_timestamp(column.type) and column.type.tz is None else column


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.log = Pieces(options)

    def partitions(self) -> Sequence[InputPartition]:
        state = self.log.state()
        return self.log.pieces(self.log.resolved(self.log.starting, state), self.log.resolved(self.log.ending, state))

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return self.log.records(partition) if partition else iter(())  # Spark asks for one piece where there is none


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.log = Pieces(options)

    def initialOffset(self) -> dict:
        return self.log.resolved(self.log.starting, self.log.state())

    def planned(self) -> dict | None:
        """Where the last planned batch ends, from the checkpoint."""
        fs, path = opened(self.log.checkpoint)
        numbers = [int(n) for p in children(fs, f"{path}/offsets") if (n := p.rsplit("/", 1)[-1]).isdigit()]
        if not numbers:
            return None
        last = text_of(fs, f"{path}/offsets/{max(numbers)}").split("\n")[2]  # version, batch, then one line a source
        return json.loads(last)

    def latestOffset(self) -> dict:
        state = self.log.state()
        end = self.log.resolved("latest", state)
        if self.log.most is None:
            return end
        begin = self.planned()
        begin = self.initialOffset() if begin is None else {p: begin.get(p, 0) for p in end}
        begin = {p: min(end[p], max(o, s)) for (p, o), (_, s, _) in zip(begin.items(), log_ranges(state), strict=True)}  # what retention dropped counts for nothing
        arrears = {p: end[p] - begin[p] for p in end}
        total = sum(arrears.values())
        if total <= self.log.most:
            return end
        share = {p: self.log.most * n // total for p, n in arrears.items()}
        rest = self.log.most - sum(share.values())
        for p in sorted(arrears, key=lambda p: arrears[p], reverse=True)[:rest]:
            share[p] += 1
        return {p: begin[p] + min(share[p], arrears[p]) for p in end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.log.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.records(partition)


class OffsetLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_log"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(self.options)
