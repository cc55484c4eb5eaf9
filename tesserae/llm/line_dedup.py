"""Lines that many documents share: hashes in ranges, documents and positions in order within, and a bitmap of kept lines a document.

Texts stay where they are while lines are compared. The steps:

1. a narrow row (digest of the key, document, position) a line with a key. A line's key is the line without ASCII white space at both ends,
   A-Z lower-cased; digests are MD5 (128 bits);
2. the rows are dealt out by ranges of (digest, document) and sorted by digest, document and position in each range. A line that a
   third of all documents hold spreads over many ranges;
3. one stream over each range finds the runs of a digest, their first occurrences and the number of their documents. Of a run it holds
   only rows of fewer than MIN_DOCS documents; then the rest passes by. A run at a border of a range may go on in the next one: if its
   own range can't decide it, its rows (again of fewer than MIN_DOCS documents) meet their digest's total over all ranges;
4. dropped positions are gathered by document into a zlib-compressed bitmap, which texts meet once, by document.

With keep_first, the first occurrence in the order of (document, position) stays.

A document is a row: a row's copies count once each, and share one bitmap, as documents are told apart by id and 64 bits of their text.

Defined results: a null or empty text is one empty line, which has no key and stays; null ids are ids like any other; very long texts
are worked on whole; an empty table gives an empty table; in `cleaned`, all columns are kept, whatever their names, but for the two counts,
which replace columns of their names, and a null text stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import aside, row_blocks
from tesserae.session import ensure_checkpoint_dir, ship

MIN_DOCS = 10
MIN_CHARS = 1
BLANK = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_rows(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """id, copy, salt, pos, h: a row a line with a key."""
    lines = docs.select(F.col(id_col).alias("id"), copy_of(F.col(text)).alias("copy"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("id", "copy", F.spark_partition_id().alias("salt"), "pos", key_of(F.col("line")).alias("key"))
    return keyed.where((F.col("key") != "") & (F.length("key") >= min_chars)).select("id", "copy", "salt", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))


def copy_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


class Runs:
    """The stream over one range. Rows come sorted; `step` gives (rows, columns to add) that are settled."""

    def __init__(self, part: int, min_docs: int, keep_first: bool):
        self.part, self.min_docs, self.keep_first = part, min_docs, keep_first
        self.held: pa.Table | None = None
        self.passing: bytes | None = None  # the digest whose further rows are dropped as they come
        self.begun = False

    def step(self, rows: pa.Table | None) -> list[pa.RecordBatch]:
        out, last = [], rows is None
        if rows is not None and self.passing is not None and rows.num_rows:
            same = pc.equal(rows["h"], pa.scalar(self.passing, rows.schema.field("h").type)).to_numpy(zero_copy_only=False)
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                out.append(self.marked(rows.slice(0, n), np.zeros(n, bool), np.zeros(n, np.int32)))
                rows = rows.slice(n)
            if not rows.num_rows:
                return out
            self.passing = None
        rows = self.held if rows is None else rows if self.held is None else pa.concat_tables([self.held, rows])
        self.held = None
        if rows is None or not rows.num_rows:
            return out
        rows = rows.combine_chunks()
        column = lambda name: rows[name].chunk(0)
        new_run = _changes(column("h"))
        new_doc = new_run | _changes(column("id"), column("copy"), column("salt"))
        pos = column("pos").to_numpy()
        counted = pos == pos[new_doc][np.cumsum(new_doc) - 1]  # equal rows of one task count once each
        starts = np.flatnonzero(new_run)
        docs = np.add.reduceat(counted, starts, dtype=np.int64)
        run = np.cumsum(new_run) - 1
        many = docs >= self.min_docs
        border = np.zeros(len(starts), bool)
        border[0] = not self.begun
        border[-1] = True  # whether the range ends with it isn't known before its end
        take = np.ones(len(starts), bool)
        if not last:
            if many[-1]:
                self.passing = column("h")[-1].as_py()
            else:
                self.held = rows.slice(int(starts[-1]))
                take[-1] = False
        lead = new_run
        settled = take[run] & many[run] & ~(lead & (border[run] | self.keep_first))
        unsettled = take[run] & border[run] & (lead | ~many[run])
        if settled.any():
            found = rows.filter(pa.array(settled))
            out.append(self.marked(found, np.zeros(found.num_rows, bool), np.zeros(found.num_rows, np.int32)))
        if unsettled.any():
            found = rows.filter(pa.array(unsettled))
            out.append(self.marked(found, lead[unsettled], np.where(lead, np.minimum(docs, self.min_docs)[run], 0)[unsettled].astype(np.int32), True))
        self.begun = self.begun or bool(take[0])
        return out

    def marked(self, rows: pa.Table, lead: np.ndarray, docs: np.ndarray, unsettled: bool = False) -> pa.RecordBatch:
        n = rows.num_rows
        h = rows["h"].combine_chunks() if unsettled else pa.nulls(n, rows.schema.field("h").type)
        columns = {"id": rows["id"], "copy": rows["copy"], "pos": rows["pos"], "h": h, "docs": pa.array(docs), "lead": pa.array(lead), "part": pa.array(np.full(n, self.part, np.int32))}
        return pa.table(columns).combine_chunks().to_batches()[0]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False, min_chars: int = MIN_CHARS, parts: int | None = None) -> DataFrame:
    """id, copy, pos: the lines that go."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = line_rows(docs, id_col, text, min_chars)
    order = ["h", "id", "copy", "salt"]
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    names = [T.StructField("id", lines.schema["id"].dataType), T.StructField("copy", T.LongType()), T.StructField("pos", T.IntegerType())]
    names += [T.StructField("h", T.BinaryType()), T.StructField("docs", T.IntegerType()), T.StructField("lead", T.BooleanType()), T.StructField("part", T.IntegerType())]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(TaskContext.get().partitionId(), min_docs, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from runs.step(pa.table(batch))
        yield from runs.step(None)

    seen = dealt.mapInArrow(stream, T.StructType(names)).checkpoint()
    at_borders = seen.where("h IS NOT NULL")
    totals = at_borders.groupBy("h").agg(F.sum("docs").alias("_docs"), F.min("part").alias("_first")).where(F.col("_docs") >= min_docs)
    gone = at_borders.join(totals, "h")
    if keep_first:
        gone = gone.where(~(F.col("lead") & (F.col("part") == F.col("_first"))))
    return seen.where("h IS NULL").select("id", "copy", "pos").union(gone.select("id", "copy", "pos"))


def packed(dropped: list[int]) -> bytes:
    """The compressed bitmap of kept lines, a bit a line to the end of the last dropped one's byte; all later lines stay."""
    bits = np.ones(max(dropped) // 8 * 8 + 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def kept(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of n_lines stay."""
    out = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        out[: len(bits)] = bits
    return out


def keep_maps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """id, copy, bitmap: a row a document that loses lines. how: what `dropped_lines` takes further."""
    gone = dropped_lines(docs, id_col, text, **how)
    by_doc = gone.groupBy("id", "copy").agg(F.collect_set("pos").alias("pos"))
    schema = T.StructType([*by_doc.schema.fields[:2], T.StructField("bitmap", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(x) for x in b.column(2).to_pylist()], pa.binary())], names=schema.names)

    return by_doc.mapInArrow(pack, schema)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the text that stays, and n_lines (before) and n_dropped."""
    named, back = aside(docs, id_col, text)
    maps = keep_maps(docs.select(id_col, text), id_col, text, **how).withColumnsRenamed({"id": "_id", "copy": "_copy", "bitmap": "_bitmap"})
    # a bitmap is smaller than its text, and there is one a document at most: a task's share of them fits where its texts do. Texts needn't be sorted.
    met = named.join(maps.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_id")) & (copy_of(F.col(text)) == F.col("_copy")), "left").drop("_id", "_copy")
    schema = T.StructType([f for f in met.schema if f.name != "_bitmap"] + [T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    ship(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, text):
                texts, bitmaps = part.column(part.schema.get_field_index(text)), part.column(part.schema.get_field_index("_bitmap"))
                n_lines, n_dropped, out = np.ones(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), texts.to_pylist()
                for i, (t, bitmap) in enumerate(zip(out, bitmaps.to_pylist(), strict=True)):
                    n_lines[i] = (t or "").count("\n") + 1
                    if bitmap is not None:
                        stay = kept(bitmap, n_lines[i])
                        n_dropped[i] = n_lines[i] - stay.sum()
                        out[i] = "\n".join([x for x, k in zip(t.split("\n"), stay, strict=True) if k])
                arrays = [pa.array(out, texts.type) if n == text else part.column(k) for k, n in enumerate(part.schema.names) if n != "_bitmap"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(n_dropped)], names=schema.names)

    new = [F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped")]
    return met.mapInArrow(apply, schema).select(*[c for c, n in zip(back, docs.columns, strict=True) if n not in ("n_lines", "n_dropped")], *new)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The contract's row a document."""
    out = cleaned(docs.select(id_col, text), id_col, text, **how)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
s AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL) AS stays, count(*) AS n_lines, count(f.key) AS n_dropped FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(stays, '')) AS kept_sha256 FROM d JOIN s USING (r)
"""
