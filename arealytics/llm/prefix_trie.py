"""The trie of conversation prefixes, with count-min screening.

1. Every prefix of a conversation gets a digest, chained over its turns (role and text) while the sorted turns stream by.
2. Count-min counters over all digests, of a fixed size, screen them: an estimate of one proves that no other conversation starts so. From
   the first such prefix on a conversation is alone; its tail of nodes is emitted from one row with its length, no prefix of it is shuffled.
3. Only prefixes that may be shared are grouped by digest, exactly. A false alarm is a group of one.
4. Subtree figures need no walk down the trie: a conversation speaks for each node of which it is the smallest member, so every node,
   leaf and saved turn is counted by one conversation and summed over the prefixes of that conversation.

Groups that hold many conversations (the root, a common first turn) are combined before shuffles and joined by broadcast of the groups above
HOT members, if those are few; all ids that end at one node pass through one SHA-256, which is sequential by its nature, as a sorted stream
of joined blocks of ids.

Defined results: rows with a NULL conversation id belong to no conversation; NULL turns come first and equal turns are ordered by role and
text; NULL role or text is empty; repeated rows are repeated turns; one conversation streams through one task, whatever its length; an empty
table has no root; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealytics.session import broadcast_if_small

from . import sketch
from .common import released, written

HOT, ID_BLOCK = 4096, 12


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, text) of a table with conv_id, turn, role and text."""
    read = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return read.select("conv_id", F.row_number().over(order).alias("place"), "role", "text")


def members(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def spliced(conversations: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c gets the first h turns of conversation c - c % every, then its own turns after its first h,
    with h = crc32(decimal c) % most. Returns their turns (as `ordered` does) and their ids, turnless ones included."""
    own = written(ordered(conversations))
    sizes = written(own.groupBy("conv_id").agg(F.count("*").alias("size")))
    plan = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there")), "base", "left")
    plan = written(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).cast("int").alias("taken")))
    heads = own.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    front = plan.join(heads, "base").where("place <= taken").select("conv_id", "place", "role", "text")
    back = own.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "role", "text")
    return front.unionByName(back), plan.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, size): every prefix with its digest and the code points of its last text."""
    def chained(batches):
        last, digest, depth = None, b"", 0
        for batch in batches:
            ids, digests, depths, sizes = batch.column("conv_id").to_pylist(), [], [], []
            for own, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if own != last:
                    last, digest, depth = own, b"", 0
                role = role.encode("utf-8", "surrogatepass")
                digest = hashlib.blake2b(digest + len(role).to_bytes(8, "little") + role + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                depth += 1
                digests.append(digest)
                depths.append(depth)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["conv_id", "depth", "digest", "size"])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(released(chained), "conv_id long, depth long, digest binary, size long")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in batch.column("digest").to_pylist()), np.uint64)


def screened(found: DataFrame, bits: int, rows: int) -> DataFrame:
    """The prefixes with `shared`: false where count-min proves that only one conversation starts so."""
    def ones(batches):
        for batch in batches:
            keys = _keys(batch)
            yield keys, np.ones(len(keys), np.int64)

    packed = found.sparkSession.sparkContext.broadcast(sketch.reached(found, ones, bits, 2, rows))

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch.holds(packed.value, _keys(batch)))], [*batch.schema.names, "shared"])

    return found.mapInArrow(released(mark), "conv_id long, depth long, digest binary, size long, shared boolean")


def ends_of(ended: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the ids at each digest, in order. Ids are joined in blocks first; the hash then reads sorted blocks."""
    blocks = ended.groupBy("digest", F.shiftright("conv_id", ID_BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = digest, hashlib.sha256()
                state.update(ids.encode())
            yield _pairs(out)
        if last is not None:
            yield _pairs([(last, state.hexdigest())])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["digest", "ends_sha256"])

    return blocks.repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(hashed, "digest binary, ends_sha256 string")


def nodes(turns: DataFrame, ids: DataFrame, bits: int = 22, rows: int = 2) -> DataFrame:
    """One row per node of the trie over `turns` (conv_id, place, role, text); `ids` lists all conversations (conv_id), so that turnless
    ones count at the root. `bits` and `rows` size the counters."""
    found = written(prefixes(turns))
    marked = written(screened(found, bits, rows))
    lengths = marked.groupBy("conv_id").agg(F.max("depth").alias("length"), F.min(F.when(~F.col("shared"), F.col("depth"))).alias("alone"))
    convs = ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"), "alone")
    convs = written(convs.withColumn("alone", F.coalesce("alone", F.col("length") + 1)))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("size"), "length", "alone")
    shared = written(marked.select("conv_id", "depth", "digest", "size").join(convs, "conv_id").where("depth < alone").unionByName(roots))

    groups = written(shared.groupBy("digest").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), F.sum((F.col("length") > F.col("depth")).cast("long")).alias("longer")))
    hot = groups.where(F.col("n_convs") >= HOT)
    crowded = shared.join(broadcast_if_small(hot), "digest", "left")
    known = crowded.where("first IS NOT NULL")
    rest = crowded.where("first IS NULL").drop("first", "n_convs", "longer").join(groups.where(F.col("n_convs") < HOT), "digest")

    down, up = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    speaks = F.col("conv_id") == F.col("first")
    # Whether the conversation stands for a leaf, seen from its last shared prefix.
    leaf = (F.col("length") > F.col("depth")) | (speaks & (F.col("longer") == 0))
    told = known.unionByName(rest).withColumn("speaks", speaks)
    told = told.withColumn("before", F.lag("first").over(down)).withColumn("child", F.coalesce(F.lead("speaks").over(down), F.col("length") > F.col("depth")))
    told = told.withColumn("leaf", F.first(leaf).over(up)).withColumn("saved", F.sum(F.when(F.col("speaks"), 0).otherwise(F.col("size"))).over(up))
    told = written(told)

    own = told.groupBy("digest", "depth").agg(F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("speaks"), F.col("before"))).alias("parent_conv_id"), F.count("*").alias("n_convs"),
                                              F.sum(F.col("child").cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    own = own.join(ends_of(told.where("length = depth").select("digest", "conv_id")), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))

    one, none, here = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("at") == F.col("length")
    tails = told.where("depth = alone - 1 AND alone <= length").withColumn("at", F.explode(F.sequence("alone", "length")))
    tails = tails.select("conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("alone"), F.col("first")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
                         F.when(here, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
                         F.sha2(F.when(here, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"))
    return own.select(tails.columns).unionByName(tails)
