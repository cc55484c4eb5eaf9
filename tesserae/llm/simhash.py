"""SimHash near-duplicates: fingerprints embedded as popcounts of segments, joined on a grid, verified exactly.

1. A document's fingerprint: bit i is 1 if it is set in over half the XXH64 hashes of its word shingles. Equal fingerprints are one
   row from here on, so a group of copies, however large, costs one.
2. The embedding: 32 segments of two bits, each by its number of set bits. The Manhattan distance of two embeddings is at most
   the Hamming distance of the fingerprints, so fingerprints within 2 differ in at most two segments.
3. The grid: segments form six groups; two embeddings within distance 2 agree on four groups whole, so a cell is a choice of four
   groups and the counts in them: 15 cells a fingerprint. A pair meets in every cell it shares and is taken in the first only.
4. In a cell, pairs pass the Manhattan bound, then the exact distance. Only a spanning forest of the links found leaves a task, at
   most one row a fingerprint, not all pairs of a group. A cell of many fingerprints is searched by flipping one or two bits of each, so
   its cost is linear.
5. Links join into components by star contraction.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; rows with a null id
never name a component; very long texts are read whole; ties of a bit go to 0; repeated rows are of one component; an empty table gives an
empty table; of documents, only the id and the text are read, so names of other columns can't clash.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import append, aside
from tesserae.llm.components import components
from tesserae.session import ensure_checkpoint_dir, ship

SHINGLE = 3
HASH_SEED = 42
RADIUS = 2
#: Bits of each group of segments.
GROUPS = [(0, 12), (12, 22), (22, 32), (32, 42), (42, 54), (54, 64)]
MASKS = [sum(((1 << b) - 1) & ~((1 << a) - 1) for a, b in four) for four in combinations(GROUPS, len(GROUPS) - RADIUS)]
#: Cells up to this size are compared pair by pair in a task; beyond, by flipping bits.
PAIRWISE = 3_000

#: A byte's bits, each in a byte of its own, to be added up in one sum.
SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)
FLIPS = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], np.uint64)


def shingle_hashes(text: bytes) -> list[int]:
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(whole, HASH_SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1]
    return list(map(xxhash.xxh64_intdigest, map(whole.__getitem__, map(slice, starts.tolist(), ends[SHINGLE - 1 :].tolist())), repeat(HASH_SEED)))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes lie one after another; none: zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes[full])
    pieces = -(-sizes[full] // 255)  # sums of bytes hold up to 255 rows
    first = np.repeat(ends - sizes[full], pieces)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    begins = np.cumsum(pieces) - pieces
    for k in range(8):
        part = np.add.reduceat(SPREAD[octets[:, k]], first + 255 * within).astype("<u8").view(np.uint8).reshape(-1, 8)
        many = np.add.reduceat(part.astype(np.int64), begins, axis=0)
        bits = (2 * many > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with the fingerprint of each whole text, as a signed long."""

    def work(a: pa.Array) -> list[np.ndarray]:
        hashes, sizes = [], []
        for t in a.cast(pa.large_binary()).to_pylist():
            h = shingle_hashes(t)
            sizes.append(len(h))
            hashes.append(np.array(h, np.uint64))
        return [majority(np.concatenate(hashes), np.array(sizes, np.int64)).view(np.int64)]

    return append(df, text, [T.StructField(out, T.LongType())], lambda: work)


def embedding(fp: Column) -> Column:
    """Popcounts of two-bit segments, packed: each field holds 0, 1 or 2."""
    odd, upper = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseXOR(upper).bitwiseAND(odd))


def packed(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings. A field that differs from 1 to 0 or 2 counts 1, from 0 to 2 counts 2."""
    odd, even = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    x = a ^ b  # 01 or 11: one step; 10: two
    return np.bitwise_count(x & odd).astype(np.int64) + 2 * np.bitwise_count((x & even) & ~((x & odd) << np.uint64(1))).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which pairs are within the radius and meet in this cell first."""
    va, vb = packed(a), packed(b)
    ok = manhattan(va, vb) <= RADIUS  # the lower bound; what passes is verified
    ok &= np.bitwise_count(a ^ b) <= RADIUS
    differ = va ^ vb
    for j, mask in enumerate(MASKS[:-1]):
        ok &= (cell <= j) | ((differ & np.uint64(mask)) != 0)
    return ok


def links(fp: np.ndarray, choice: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells; rows of a cell lie together, ends are where cells end."""
    size = np.diff(ends, prepend=0)
    left, right = [], []
    small = np.repeat(size <= 64, size)
    run = np.repeat(np.arange(len(size)), size)
    for lag in range(1, int(size[size <= 64].max(initial=1))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
        i = i[linked(fp[i], fp[i + lag], choice[i])]
        left.append(i)
        right.append(i + lag)
    for r in np.flatnonzero(size > 64):
        s, e = ends[r] - size[r], ends[r]
        part, c = fp[s:e], choice[s:e]
        if len(part) <= PAIRWISE:
            seats = packed(part)
            for k in range(0, len(part), 256):
                i, j = np.nonzero(manhattan(seats[k : k + 256, None], seats[None, :]) <= RADIUS)  # the bound, then the exact distance
                i += k
                i, j = i[i < j], j[i < j]
                keep = linked(part[i], part[j], c[i])
                left.append(s + i[keep])
                right.append(s + j[keep])
        else:
            order = np.argsort(part, kind="stable")
            ranked = part[order]
            for flip in FLIPS[1:]:
                at = np.minimum(np.searchsorted(ranked, part ^ flip), len(part) - 1)
                i = np.flatnonzero((ranked[at] == part ^ flip) & (part < part ^ flip))
                j = order[at[i]]
                keep = linked(part[i], part[j], c[i])
                left.append(s + i[keep])
                right.append(s + j[keep])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those pairs that join what was apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def cell_links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp (long). Gives a, b: links that join all fingerprints that links join."""
    ship(fps.sparkSession)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    v = embedding(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), v.bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(MASKS)])
    rows = fps.select("fp", F.explode(cells).alias("c")).select("fp", "c.choice", "c.cell")
    rows = rows.repartition(F.col("choice"), F.col("cell")).sortWithinPartitions("choice", "cell")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        held: list[np.ndarray] = []  # rows of the last cell, which the next batch may go on with

        def found(rows: np.ndarray):
            if len(rows) < 2:
                return
            fp, choice, cell = rows[0], rows[1], rows[2]
            ends = np.append(np.flatnonzero((choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])) + 1, len(fp))
            size = np.diff(ends, prepend=0)
            many = np.repeat(size > 1, size)
            i, j = links(fp[many].view(np.uint64), choice[many], np.cumsum(size[size > 1]))
            pairs = forest(fp[many][i].tolist(), fp[many][j].tolist())
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.array([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)]))
            first, last = held[0][:, 0], held[-1][:, -1]
            if (first[1:] == last[1:]).all():
                continue  # one cell still
            rows = np.concatenate(held, axis=1)
            cut = len(rows[0]) - int(np.argmin(((rows[1] == last[1]) & (rows[2] == last[2]))[::-1]))
            yield from found(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield from found(np.concatenate(held, axis=1))

    return rows.mapInArrow(run, schema)


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, _text (a hash of the text), component_id (the smallest id reachable), root (a name for the component, never null)."""
    ensure_checkpoint_dir(docs.sparkSession)
    narrow = fingerprints(docs.select(id_col, text, F.xxhash64(text).alias("_text")), text, "fp").select(id_col, "fp", "_text").checkpoint()
    fps = narrow.groupBy("fp").agg(F.min(id_col).alias("_low"))
    joined = components(cell_links(fps.select("fp")))
    named = fps.join(joined, fps.fp == joined.node, "left").select("fp", "_low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("_low").alias("component_id"))
    # met on a hash, by which neither side is dealt out already: a fingerprint of very many copies can then be split
    names = named.join(low, "root").select("fp", "root", "component_id", F.xxhash64(F.lit(5), "fp").alias("_h"))
    rows = narrow.withColumn("_h", F.xxhash64(F.lit(5), "fp"))
    met = rows.join(names.withColumnRenamed("fp", "_fp"), "_h").where("fp = _fp")
    return met.select(id_col, "fp", "_text", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return grouped(docs, id_col, text).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, as it is: that of the smallest id (a null id comes last, then the text's hash decides; of rows
    equal in both, the first by all columns as JSON).

    Texts are dealt out once, to meet the rows that stay; those are a few numbers each and are what is held in memory. Sorting the texts
    instead would let the join spill, but costs five times the input on disk.
    """
    rows = grouped(docs, id_col, text).groupBy("root", id_col, "_text").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col("_text").alias("t"), "n"))
    stay = rows.groupBy("root").agg(first.alias("x")).select(F.col("x.id").alias("_id"), F.col("x.t").alias("_t"), F.col("x.n").alias("_n")).checkpoint()
    named, back = aside(docs, id_col, text)
    met = named.withColumn("_h", F.xxhash64(text)).join(stay.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")))
    if stay.where("_n > 1").limit(1).count():  # rows that are equal in id and text
        every = F.struct(*[F.col(f"`{c}`") for c in met.columns])
        one = met.where("_n > 1").groupBy("_id", "_t").agg(F.min_by(every, F.to_json(every)).alias("x")).select("x.*")
        met = met.where("_n = 1").unionByName(one)
    return met.select(*back)
