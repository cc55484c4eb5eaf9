"""What several operators of this subpackage share."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import ship

#: A text of this many bytes is worked on at once at least; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """df with all columns but the used ones under names that clash with nothing, and what brings the names back."""
    other = {c: f"__aside{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns]


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], block: int = BLOCK_BYTES) -> DataFrame:
    """Columns computed in Python from one text column, beside all columns of df.

    make() is called once a task and gives a function from an Arrow string array (nulls as empty texts) to one list or
    numpy array a field. A column of df with the name of a new one is replaced. Rows stay in their partitions; nothing
    is kept between batches.
    """
    ship(df.sparkSession)
    new = {f.name for f in fields}
    keep = [f.name for f in df.schema if f.name not in new]
    schema = T.StructType([f for f in df.schema if f.name not in new] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in row_blocks(batch, text, block):
                if types is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    types = [to_arrow_type(f.dataType) for f in fields]
                values = work(filled(part.column(part.schema.get_field_index(text))))
                arrays = [part.column(part.schema.get_field_index(n)) for n in keep]
                arrays += [pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def filled(array: pa.Array) -> pa.Array:
    """As large strings without nulls."""
    array = array.cast(pa.large_string())
    return array.fill_null("") if array.null_count else array


def row_blocks(batch: pa.RecordBatch, text: str, block: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `block` bytes of text: memory is bounded whatever the number of rows in a batch."""
    ends = np.cumsum(np.asarray(lengths(batch.column(batch.schema.get_field_index(text)))))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + block, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a large-string array without nulls."""
    n = len(array)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def span_text(spans: list[tuple]) -> str:
    """kind:start:end, comma-joined; the spans come in order."""
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


class Taken:
    """Stretches of a text that are taken already; asks and additions take the logarithm of their number."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # the stretches before it begin left of the end
        return not at or self.ends[at - 1] <= start

    def add(self, start: int, end: int) -> bool:
        """Whether the stretch was free; it is taken now."""
        if not self.free(start, end):
            return False
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("base", T.BooleanType()),
    ]
)


def span_digests(df: DataFrame, spans: str, kinds: list[str]) -> list[Column]:
    """Counts a base kind, the hash over base spans, and all spans as text."""
    base = F.filter(F.col(spans), lambda s: s["base"])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col(spans)).alias("spans")]
