"""Trie of conversation prefixes with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns; its key is its depth and 128 bits that the positions and hashes of its turns add up
to by exclusive or, so keys come from running sums and no conversation has to lie in one task. Each node's child with
the most conversations (of several, that of the smallest conversation) is its heavy child; heavy children make paths, one for each
childless node, and a step from path to path at least halves the conversations, so there are at most log2 of them from the
root down. Sums over subtrees are suffix sums along the paths: the paths that most steps lie above go first, their totals are summed
by the node that they hang on, then come the paths of one step less.

Running sums (``running``) are cut by range of (group, order), with one row per task to the driver, so one conversation or
path may hold any share of the rows. Joins on nodes that many share have two written sides, which adaptive execution can split.

Defined cases: rows without a conv_id belong to no conversation; null role and text are empty; turns that are equal or null
follow in order of a hash of role and text, null first; repeated rows are turns of their own; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import new_path, slices, staged, table

#: Turns that a conversation may get from the first of its block, and conversations of a block.
HEAD, BLOCK = 5, 100
#: Characters of joined ids in one row.
CHUNK = 64_000
KEY = ["d", "p1", "p2"]
NO_IDS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, group: str, order: list[str | Column], name: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows``, written, with ``run_x`` for each x of ``sums`` and ``xors``: the sum or exclusive or of x up to the row, in its ``group`` by ``order``.

    ``group`` and what is summed are longs without nulls. Rows are range-partitioned, so a group may lie in many tasks.
    """
    spark = rows.sparkSession
    runs = [f"run_{c}" for c in (*sums, *xors)]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            out = []
            for c in (*sums, *xors):
                step, back = (np.add, np.subtract) if c in sums else (np.bitwise_xor, np.bitwise_xor)
                total = step.accumulate(batch.column(c).to_numpy())
                before = np.concatenate([[0], total[starts[1:] - 1]]) if len(starts) > 1 else np.zeros(1, np.int64)
                own = back(total, before[of])
                if g[0] == last:
                    own[of == 0] = step(own[of == 0], carry[c])
                carry[c] = own[-1]
                out.append(pa.array(own))
            last = g[-1]
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), *out], names=[*batch.schema.names, "_part", "_seq", *runs])
            seq += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _part int, _seq long, " + ", ".join(f"{r} long" for r in runs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = staged(rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).mapInArrow(accumulate, kinds), name)
    ends = held.groupBy("_part").agg(F.min(group).alias("first"), F.max(F.struct(group, "_seq", *runs)).alias("end")).orderBy("_part").collect()
    # a task's first group may have begun in the tasks before: one row per task
    offsets, carried, so_far = [], None, {}
    for e in ends:
        ahead = so_far if carried == e.first else dict.fromkeys(runs, 0)
        if any(ahead.values()):
            offsets.append((e._part, e.first, *ahead.values()))
        same = e.end[group] == e.first
        carried = e.end[group]
        so_far = {r: (e.end[r] ^ (ahead[r] if same else 0)) if r[4:] in xors else e.end[r] + (ahead[r] if same else 0) for r in runs}
    if offsets:
        side = spark.createDataFrame(offsets, f"_part int, {group} long, " + ", ".join(f"_{r} long" for r in runs))
        held = held.join(F.broadcast(side), ["_part", group], "left")
        zero = F.lit(0).cast("long")
        for r in runs:
            off = F.coalesce(f"_{r}", zero)
            held = held.withColumn(r, F.col(r).bitwiseXOR(off) if r[4:] in xors else F.col(r) + off)
    return held.select(*rows.columns, *runs)


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its block."""
    return F.crc32(conv_id.cast("string")) % (HEAD + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rebuilt turns (conv_id, d, x1, x2, chars), d from 1, and all conversations (conv_id)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.char_length(text).cast("long").alias("chars"),
        F.lit(1).cast("long").alias("i"),
    )
    own = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "a", "b"], "turns", sums=("i",)).withColumn("i", F.col("run_i"))
    ids = staged(own.groupBy("conv_id").agg(F.max("i").alias("n")), "conversations")
    heads = own.filter((F.col("conv_id") % BLOCK == 0) & (F.col("i") <= HEAD))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "chars"))).alias("head"))  # HEAD at most
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,a:bigint,b:bigint,chars:bigint>>")), 1, F.col("h").cast("int"))
    based = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), taken(F.col("conv_id")).alias("h"))
    given = staged(based.join(heads, "base", "left").select("conv_id", "h", head.alias("head")), "conversation-heads")
    borrowed = given.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.i").alias("d"), "t.a", "t.b", "t.chars")
    # own turns move up where the head is shorter than asked for
    short = given.filter(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("less"))
    kept = own.filter(F.col("i") > taken(F.col("conv_id"))).join(short, "conv_id", "left")
    kept = kept.select("conv_id", (F.col("i") - F.coalesce("less", F.lit(0))).alias("d"), "a", "b", "chars")
    both = borrowed.unionByName(kept)
    return both.select("conv_id", "d", F.xxhash64("d", "a", "b").alias("x1"), F.xxhash64(F.lit(1), "d", "a", "b").alias("x2"), "chars"), ids.select("conv_id")


def nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """KEY, q1, q2 (key of the parent, one level up), conv_id (smallest member), n_convs, chars of every node; ``turns`` has KEY."""
    zero = F.lit(0).cast("long")
    top = ids.select("conv_id", *(zero.alias(c) for c in (*KEY, "x1", "x2", "chars")))
    met = turns.select(top.columns).unionByName(top)
    found = met.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("x1").alias("x1"), F.min("x2").alias("x2"), F.min("chars").alias("chars"))
    return found.select(*KEY, F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "conv_id", "n_convs", "chars")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of every node where conversations end; ``ends`` has KEY and conv_id.

    A hash reads its ids in order, so a node's ids come to one task: joined, in pieces, and read one after the other.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "first", "ids"]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.string() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*held, strict=True), strict=True)], names=names)

        key, ids, size, out = None, [], 0, []
        for piece in slices(batches, 4_096):
            for *k, conv in zip(*(piece.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if ids and (k != key or size >= CHUNK):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                key, size = k, size + 8
                ids.append(conv)
            if len(out) >= 1_024 or size and out:
                yield rows(out)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        if out:
            yield rows(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])

        for piece in slices(batches, 64):
            done = []
            for *k, ids in zip(*(piece.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ordered.mapInArrow(join, "d long, p1 long, p2 long, first long, ids string")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "d long, p1 long, p2 long, ends_sha256 string")


def heavy_paths(turns: DataFrame, found: DataFrame, children: DataFrame) -> tuple[DataFrame, int]:
    """level, path, up (depth from the leaf's end, negative), KEY, q1, q2, is_top, leaves, saved of every node, and the highest level.

    A path is named by the smallest member of its leaf, whose turns are the leaf's way to the root; its level is the number of
    nodes on that way that are no heavy children, the last of which is the path's top.
    """
    spark = found.sparkSession
    heavy = children.select((F.col("d") + 1).alias("d"), F.col("heavy.p1").alias("p1"), F.col("heavy.p2").alias("p2"))
    light = staged(found.filter("d > 0").join(heavy, KEY, "left_anti").select(*KEY), "trie-light")
    tops = turns.select("conv_id", *KEY).join(light, KEY).groupBy("conv_id").agg(F.max("d").alias("top"), F.count("*").alias("level"))
    leaves = found.join(children.select(*KEY), KEY, "left_anti").select("conv_id")
    none = F.lit(0).cast("long")
    ways = staged(leaves.join(tops, "conv_id", "left").select("conv_id", F.coalesce("top", none).alias("top"), F.coalesce("level", none).alias("level")), "trie-ways")
    on = turns.select("conv_id", *KEY).join(ways, "conv_id").filter("d >= top")
    root = ways.filter("top = 0").select("conv_id", *(none.alias(c) for c in KEY), "top", "level")
    placed = staged(on.unionByName(root), "trie-placed")
    inner = children.select(*KEY, F.lit(True).alias("inner"))
    full = placed.withColumnRenamed("conv_id", "path").join(found, KEY).join(inner, KEY, "left")
    full = full.select(
        "path",
        (-F.col("d")).alias("up"),
        *KEY,
        "q1",
        "q2",
        (F.col("d") == F.col("top")).alias("is_top"),
        F.when(F.col("inner"), none).otherwise(F.lit(1).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        "level",
    )
    path = new_path(spark, "trie-paths")
    full.write.partitionBy("level").parquet(path)  # so that each round reads its own paths only
    return spark.read.schema(full.schema).parquet(path), ways.agg(F.max("level")).first()[0] or 0


def subtree_sums(paths: DataFrame, levels: int) -> DataFrame:
    """KEY, run_leaves, run_saved of every node: suffix sums along paths, from the highest level down."""
    done, hung = None, None
    for level in range(levels, -1, -1):
        here = paths.filter(F.col("level") == level).drop("level")
        if hung is not None:
            here = here.join(hung, KEY, "left")
            here = here.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        sums = running(here, "path", ["up"], "trie-sums", sums=("leaves", "saved"))
        own = sums.select(*KEY, "run_leaves", "run_saved")
        done = own if done is None else done.unionByName(own)
        if level:
            above = sums.filter("is_top").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
            hung = staged(above.agg(F.sum("run_leaves").alias("more_leaves"), F.sum("run_saved").alias("more_saved")), "trie-hung")
    return done


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``conversations`` has conv_id, turn, role, text. Every conversation is rebuilt first: the first turns (``taken``) of the first one of its block
    of ids stand in place of as many of its own. conv_id is the node's smallest member; saved_tokens are the characters that a
    subtree's conversations need not repeat.
    """
    turns, ids = rebuilt(conversations)
    turns = running(turns, "conv_id", ["d"], "trie-turns", xors=("x1", "x2")).withColumnsRenamed({"run_x1": "p1", "run_x2": "p2"})
    found = staged(nodes(turns, ids), "trie-nodes")
    below = found.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    least = (-F.col("conv_id")).alias("least")
    children = staged(below.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", least, "p1", "p2")).alias("heavy")), "trie-children")
    paths, levels = heavy_paths(turns, found, children)
    sums = subtree_sums(paths, levels)
    zero = F.lit(0).cast("long")
    last = turns.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"end.{c}", zero).alias(c) for c in KEY))
    hashes = staged(ends_hashes(staged(ends, "trie-ends")), "trie-hashes")
    up = found.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    # the root's children, which may be most nodes, need no join
    root = found.filter("d = 0").select(F.col("conv_id").alias("root"))
    named = found.filter("d <= 1").crossJoin(F.broadcast(root)).withColumn("parent_conv_id", F.when(F.col("d") == 1, F.col("root"))).drop("root")
    named = named.unionByName(found.filter("d > 1").join(up, ["d", "q1", "q2"]).select(named.columns))
    out = named.join(sums, KEY).join(children.select(*KEY, "n_children"), KEY, "left").join(hashes, KEY, "left")
    return out.select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.col("run_leaves").alias("n_leaves"),
        F.col("run_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of all rebuilt ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL: dict[str, str] = {}
