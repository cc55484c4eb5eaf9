"""Trie of conversation prefixes: which conversations share their first turns, and what tokens that saves.

Rows stay one a turn and narrow (conversation, depth, digest, words); no conversation is gathered in one row. The steps:

1. turns get their places; a turn's role and text become an MD5 digest (128 bits), its last words a count;
2. conversations with equal turns throughout are one class, known by its smallest id and its size. A class is told by the combined
   64-bit hashes of (depth, digest) under two seeds;
3. level by level: live classes meet their turn of that depth and are grouped by (parent node, turn); the smallest id names the node. A
   class that is alone in its node leaves: the rest of its turns is a chain of nodes, which needs no further level. So there are as
   many levels as different conversations share turns. When few of the turns are left to live classes, these are written anew,
   so that levels read what is live;
4. bottom up, level by level: nodes and chains that begin in them are added up by parent, and nodes meet these sums;
5. the ids of a large class are put in order by ranges, joined in pieces of PIECE ids, and the pieces pass through the hash in order.

Joins in which a node or a class may hold many rows meet on a hash by which neither side is dealt out, so run-time skew handling splits them.

Defined results: null roles and texts are empty; rows without a conversation id belong to none; turns that are equal in `turn` follow by
digest, and repeated rows are turns of their own; very long texts are digested whole; an empty table gives no nodes; only the four columns
are read, so names of others can't clash. Remainders are SQL's, so ids below 0 belong to the bases nearer to 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.mixing import words
from tesserae.operators.ranking import places
from tesserae.session import ensure_checkpoint_dir, ship

#: Conversations lend their first turns to the others of a block of so many ids.
BLOCK = 20
#: They lend fewer than this.
LENT = 4
#: Ids whose text is joined in one row.
PIECE = 500


def ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), key, words: a row a turn."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)).cast("binary")))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key.alias("key"), words(F.col(text)).alias("words"))
    return places(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("key")], "pos").select("conv", F.col("pos").cast("int").alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, block: int = BLOCK, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their block's first one: as many as crc32 of the id says, in place of as many of their own.

    turns: as `ordered` gives them. Gives conv, depth, key, words, and conv, len (0 where nothing is left).
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % lent).cast("int")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % block})
    heads = turns.where((F.col("conv") % block == 0) & (F.col("pos") < lent)).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "key", "words")
    info = convs.join(heads.groupBy("base").agg(F.max("depth").alias("has")), "base", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).checkpoint()
    own = turns.where(F.col("pos") > h).join(info.select("conv", "taken"), "conv").select("conv", (F.col("pos") - h + F.col("taken")).alias("depth"), "key", "words")
    borrowed = info.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where("depth <= taken").select("conv", "depth", "key", "words")
    return own.union(borrowed).checkpoint(), info.select("conv", F.col("len").cast("int").alias("len"))


def _meet(rows: DataFrame, sums: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of sums, one row a key; keys may be hot in rows."""
    other = sums.withColumnsRenamed({c: f"_{c}" for c in on}).withColumn("_h", F.xxhash64(F.lit(3), *[f"_{c}" for c in on]))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return rows.withColumn("_h", F.xxhash64(F.lit(3), *on)).join(other, "_h").where(same).drop("_h", *[f"_{c}" for c in on])


def classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, rep, n) and classes (rep, n, len) of conversations that are equal throughout."""
    seeded = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "depth", "key"))
    digests = turns.groupBy("conv").agg(seeded(1).alias("a"), seeded(2).alias("b"))
    signed = convs.join(digests, "conv", "left").select("conv", "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).checkpoint()
    found = signed.groupBy("len", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("n")).checkpoint()
    return _meet(signed, found, ["len", "a", "b"]).where("n > 1").select("conv", "rep"), found.select("rep", "n", "len")


def levels(turns: DataFrame, live: DataFrame, root: int) -> list[DataFrame]:
    """For each depth from 1 at which classes share nodes or leave: rep, n, len, parent, words, node, n_convs, n_classes.

    live: rep, n, len of classes with turns.
    """
    out, depth, live = [], 0, live.withColumn("parent", F.lit(root).cast("long"))
    rest = turns.withColumnRenamed("conv", "rep")
    stored = None
    while True:
        left = live.agg(F.count("*"), F.coalesce(F.sum(F.col("len") - depth), F.lit(0))).first()
        if not left[0]:
            return out
        stored = stored or left[1]
        if 2 * left[1] < stored:
            rest, stored = rest.where(F.col("depth") > depth).join(live.select("rep"), "rep", "left_semi").checkpoint(), left[1]
        depth += 1
        met = live.join(rest.where(F.col("depth") == depth).select("rep", "key", "words"), "rep")
        nodes = met.groupBy("parent", "key").agg(F.min("rep").alias("node"), F.sum("n").alias("n_convs"), F.count("*").alias("n_classes"))
        out.append(_meet(met, nodes, ["parent", "key"]).drop("key").checkpoint())
        live = out[-1].where((F.col("n_classes") > 1) & (F.col("len") > depth)).select("rep", "n", "len", F.col("node").alias("parent"))


def hashed(members: DataFrame) -> DataFrame:
    """rep, sha: of each class of more than one, the SHA-256 of its ids in order, comma-joined."""
    ship(members.sparkSession)
    placed = places(members, ["rep"], [F.col("conv")], "at").withColumn("piece", F.floor((F.col("at") - 1) / PIECE))
    pieces = placed.groupBy("rep", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    in_order = pieces.repartition("rep").sortWithinPartitions("rep", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"rep": pa.array([now], pa.int64()), "sha": [state.hexdigest()]})
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if rep == now:
                    state.update(b",")
                else:
                    if state:
                        yield row()
                    now, state = rep, hashlib.sha256()
                state.update(ids.as_py().encode())
        if state:
            yield row()

    return in_order.mapInArrow(digest, "rep long, sha string")


def chains(turns: DataFrame, left: DataFrame) -> DataFrame:
    """The nodes of classes that are alone from a depth on. left: rep, n, len, start, parent."""
    own = turns.withColumnRenamed("conv", "rep").join(left, "rep").where(F.col("depth") >= F.col("start"))
    below = F.sum("words").over(Window.partitionBy("rep").orderBy(F.col("depth").desc()))  # the turns of one conversation
    one = own.where("n = 1").withColumn("saved", F.lit(0).cast("long"))
    many = own.where("n > 1").withColumn("saved", (F.col("n") - 1) * below)
    ends = F.col("depth") == F.col("len")
    up = F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("rep"))
    return one.union(many).select(F.col("rep").alias("node"), "depth", up.alias("parent"), F.col("n").alias("n_convs"), F.when(ends, 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"), "saved", F.when(ends, F.col("rep")).alias("end"), F.col("n").alias("end_n"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes. turns: conv, depth (from 1, without gaps), key, words; convs: conv, len, a row a conversation."""
    spark = turns.sparkSession
    ensure_checkpoint_dir(spark)
    members, found = classes(turns, convs)
    root, everyone = found.agg(F.min("rep"), F.sum("n")).first()
    names = ["node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "end", "end_n"]
    if root is None:  # no conversation, no node
        return finished(spark.createDataFrame([], "node long, depth int, parent long, n_convs long, n_children long, n_leaves long, saved long, end long, end_n long"), members)
    down = levels(turns, found.where("len > 0"), root)
    no_left = found.where("false").select("rep", "n", "len", F.lit(0).alias("start"), F.col("rep").alias("parent"))
    left = reduce(DataFrame.union, [m.where("n_classes = 1").select("rep", "n", "len", F.lit(d).alias("start"), "parent") for d, m in enumerate(down, 1)], no_left)
    chain_nodes = chains(turns, left).checkpoint()
    first = left.select(F.col("rep").alias("node"), F.col("start").alias("depth"))
    begun = chain_nodes.join(first, ["node", "depth"], "left_semi").select("depth", "parent", "n_leaves", "saved").checkpoint()

    up: list[DataFrame] = []
    for depth in range(len(down), -1, -1):
        if depth:
            level = down[depth - 1].where("n_classes > 1")
            ends = level.where(F.col("len") == depth).select("node", F.col("rep").alias("end"), F.col("n").alias("end_n"))
            nodes = level.where("rep = node").select("node", "parent", "n_convs", "words")
        else:
            nodes = spark.range(1).select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(everyone).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
            ends = found.where("len = 0").select(F.lit(root).cast("long").alias("node"), F.col("rep").alias("end"), F.col("n").alias("end_n"))
        under = begun.where(F.col("depth") == depth + 1).select("parent", "n_leaves", "saved")
        under = under.union(up[-1].select("parent", "n_leaves", "saved")) if up else under
        sums = under.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("below"), F.sum("saved").alias("saved_below"))
        row = nodes.join(sums, "node", "left").join(ends, "node", "left").withColumn("depth", F.lit(depth))
        row = row.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("below", F.lit(1)), "saved": F.coalesce("saved_below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")})
        up.append(row.select(*names).checkpoint())
    return finished(reduce(DataFrame.union, up, chain_nodes.select(*names)), members)


def finished(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes with the hashes of those that end there."""
    many = nodes.where("end IS NOT NULL AND end_n > 1")
    others = nodes.where("end IS NULL OR end_n = 1").withColumn("sha", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256))
    every = others.union(many.join(hashed(members).withColumnRenamed("rep", "end"), "end").select(*nodes.columns, "sha"))
    longs = {"conv_id": "node", "depth": "depth", "parent_conv_id": "parent", "n_convs": "n_convs", "n_children": "n_children", "n_leaves": "n_leaves", "saved_tokens": "saved"}
    return every.select(*[F.col(c).cast("long").alias(n) for n, c in longs.items()], F.col("sha").alias("ends_sha256"))


def nodes(conversations: DataFrame) -> DataFrame:
    """The contract's row a node."""
    ensure_checkpoint_dir(conversations.sparkSession)
    return trie(*rebuilt(ordered(conversations)))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words, turn FROM t),
o AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(words ORDER BY turn NULLS FIRST, key) AS words FROM k GROUP BY conv_id),
h AS (SELECT *, (4294967295 - list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                 lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384))) % 4 AS h FROM o),
b AS (SELECT h.conv_id, coalesce(o.keys[1:h.h], []) || h.keys[h.h + 1:] AS keys, coalesce(o.words[1:h.h], []) || h.words[h.h + 1:] AS words FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, keys[1:d] AS path, len(keys) AS n, words FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM b)),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(words[d]) END AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, path),
c AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, path)),
s AS (SELECT a.d, a.path, count(*) FILTER (z.n_children = 0) AS n_leaves, sum((z.n_convs - 1) * z.words) AS saved FROM m a JOIN m z ON z.d >= a.d AND z.path[1:a.d] = a.path GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.d = m.d AND s.path = m.path LEFT JOIN m u ON u.d = m.d - 1 AND u.path = m.path[1:m.d - 1]
"""
