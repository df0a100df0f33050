"""Units: documents packed to some MB, written once, so that several passes over them can ask each other by unit.

A pass sends what a unit wants to know, sorted and without repeats, to tasks that hold a range of the values each; they
answer with a value for each entry. What travels grows with the units' distinct entries, a hot value is one entry a
unit, and texts stay where they are. Answers are written in the shared folder, a folder for each bundle of neighbouring
units, and the next pass reads those of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hf_path, new_dir, written
from .pieces import utf8_column

#: Bytes of text at which a unit is closed, at the end of a document. A longer document is a unit by itself.
UNIT_BYTES = 4 << 20
#: A unit is a row group by itself: the writer holds a row group and the reader decodes it whole, and by default it would
#: have a task's units all, up to 100 and more.
ONE_BY_ONE = {"parquet.block.row.count.limit": 1}
#: Units of a partition whose answers share a folder, as a power of two.
BUNDLE_BITS = 6
#: A unit's number: the partition that packed it above these bits, its place there below.
PLACE_BITS = 32
#: Bytes of rows that a task hands back at a time.
OUT_BYTES = 4 << 20


@dataclass
class Unit:
    """Documents of a unit: ids (nulls as they are), which texts are null, and the texts' bytes with their offsets."""

    number: int
    ids: object
    null: np.ndarray
    data: np.ndarray
    at: np.ndarray


def packed(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The written table of units: unit, bytes, ids, texts (arrays in the order of the rows). No shuffle."""
    import pyarrow as pa

    schema = pa.schema([("unit", pa.int64()), ("bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << PLACE_BITS
        ids, texts, held = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal number, ids, texts, held
            a, b = pa.concat_arrays(ids), pa.concat_arrays(texts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (a, b)]
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), *lists], schema=schema)
            number, ids, texts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            sizes = np.diff(utf8_column(batch.column(1))[1])
            a = 0
            while a < len(sizes):
                fits = int(np.searchsorted(np.cumsum(sizes[a:]), unit_bytes - held)) + 1
                b = min(a + fits, len(sizes))
                ids.append(batch.column(0).slice(a, b - a))
                texts.append(batch.column(1).slice(a, b - a))
                held += int(sizes[a:b].sum())
                a = b
                if held >= unit_bytes:
                    yield closed()
        if ids:
            yield closed()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(own.mapInArrow(run, "unit long, bytes long, ids array<long>, texts array<string>"), "units", compression="zstd", **ONE_BY_ONE)


def documents(units: DataFrame) -> DataFrame:
    """unit, id, text: a unit's rows stand together, in order, in one task."""
    return units.select("unit", F.explode(F.arrays_zip("ids", "texts")).alias("d")).select("unit", F.col("d.ids").alias("id"), F.col("d.texts").alias("text"))


def each_unit(batches: Iterator) -> Iterator[Unit]:
    """The units of a task that gets the rows of ``documents``."""
    import pyarrow as pa

    held: list = []

    def unit() -> Unit:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column(2).chunk(0)
        data, at = utf8_column(texts)
        return Unit(table.column(0)[0].as_py(), table.column(1).chunk(0), np.asarray(texts.is_null()), data[at[0] : at[-1]], at - at[0])

    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and held[0].column(0)[0].as_py() != numbers[a]:
                    yield unit()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield unit()


def answers(rows: DataFrame) -> str:
    """Writes rows (unit first) as the answers to their units and returns the folder."""
    folder = new_dir(rows.sparkSession, "answers")
    bundled = rows.withColumn("bundle", F.shiftright("unit", BUNDLE_BITS))
    bundled.repartition("bundle").sortWithinPartitions("bundle", "unit").write.partitionBy("bundle").option("compression", "zstd").parquet(folder)
    return folder


class Answers:
    """Reads the answers to a task's units, a bundle at a time. A unit without answers has an empty table."""

    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns
        self.bundle, self.table = None, None

    def of(self, number: int):
        """The columns, as Arrow arrays, of the unit's rows; None if it has none."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        if self.bundle != number >> BUNDLE_BITS:
            self.bundle = number >> BUNDLE_BITS
            fs, path = hf_path(f"{self.folder}/bundle={self.bundle}")
            files = [f.path for f in fs.get_file_info(_selector(path)) if f.path.endswith(".parquet")]
            tables = [pq.ParquetFile(fs.open_input_file(f)).read(["unit", *self.columns]) for f in sorted(files)]
            self.table = pa.concat_tables(tables).combine_chunks() if tables else None
            self.numbers = self.table.column("unit").to_numpy() if tables else None
        if self.table is None:
            return None
        own = np.flatnonzero(self.numbers == number)
        return [self.table.column(c).take(pa.array(own)).combine_chunks() for c in self.columns] if len(own) else None


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 of seven bits a byte, with the high bit on bytes that go on."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> np.uint64(7 * k) > 0
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    first = end - size
    for k in range(int(size.max(initial=0))):
        own = size > k
        part = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[first[own] + k] = part.astype(np.uint8) | np.where(size[own] > k + 1, np.uint8(128), np.uint8(0))
    return out.tobytes()


def unpack_numbers(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = (raw[first] & 127).astype(np.uint64)
    size = last - first + 1
    for k in range(1, int(size.max())):
        own = size > k
        out[own] |= (raw[first[own] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return pack_numbers(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_ascending(body: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(body), dtype=np.uint64)


def cuts(ascending: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(ascending)) + 1).tolist(), len(ascending)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


#: What a unit asks the task of a block: the block, the unit, how many entries, and the entries.
REQUEST = "block long, unit long, n long, body binary"
ANSWER = "unit long, block long, body binary"


def _batch(rows: list[tuple]):
    import pyarrow as pa

    block, unit, n, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(unit, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["block", "unit", "n", "body"])


def requests(make: Callable[[Unit], Iterable[tuple[int, int, int, bytes]]], batches: Iterator) -> Iterator:
    """The batches of ``REQUEST`` rows that ``make`` gives of each unit."""
    rows, held = [], 0
    for unit in each_unit(batches):
        for row in make(unit):
            rows.append(row)
            held += 24 + len(row[3])
            if held > OUT_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def answered(asked: DataFrame, merge: Callable[[list[bytes]], list[bytes]], report: Callable[[list[bytes]], bytes] | None = None) -> DataFrame:
    """unit, block, body: of each block all requests' bodies merged, and one answer to each. With ``report``, also its body
    for each block, as unit -1 - block."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        asked, unit, block = table.column("body").to_pylist(), table.column("unit").to_pylist(), table.column("block").to_pylist()
        bodies = merge(asked)
        if report:
            bodies, unit, block = [*bodies, report(asked)], [*unit, -1 - block[0]], [*block, block[0]]
        return pa.table({"unit": pa.array(unit, pa.int64()), "block": pa.array(block, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return asked.groupBy("block").applyInArrow(run, ANSWER)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports among the answers of a folder."""
    return spark.read.schema(f"{ANSWER}, bundle long").parquet(folder).where("bundle < 0")
