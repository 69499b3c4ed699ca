"""A trie of conversations by their turns, as a table of nodes.

Turns become hashes with their depth in them, so a prefix is the exclusive or of its
turns and any stretch of turns can be hashed apart. Conversations first go by blocks of
`BLOCK` turns: those that agree up to the end of a block are one row from there on. Only
where several blocks follow the same prefix are their turns looked at one by one, and
there each block counts once with all its conversations. Elsewhere a block's turns have
the members of the block.

A node belongs to its smallest member. A conversation owns the nodes from one depth on,
its entry, and what a node sums over its subtree is a sum over its members: leaves are
counted by their owners, and the turns that a member need not store are those between the
node and its entry. So no step walks from node to node, however deep the trie is.

Turns go by number, null first, and those of equal number by a hash of role and text; a
null role or text is empty. Rows without a conversation belong to none. Repeated rows are
turns of their own, other columns play no part, and an empty table has no nodes.
A conversation of any length is spread over tasks by ranges of its turns, and counts of
all members of a prefix are aggregates, never gathered rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.links import written

BLOCK = 4
# Blocks of one conversation whose hashes are run up in one task; and ids in one string.
STRETCH = 1024
IDS = 4096
# Conversations whose numbers share their hundreds begin alike.
FAMILY = 100
MOST_SHARED = 6


def _place(frame: DataFrame, *columns: str) -> DataFrame:
    """The rows in their order over all tasks, written, with the file and the row in it."""
    keys = [F.col(c).asc_nulls_first() for c in columns]
    rows = written(frame.repartitionByRange(*keys).sortWithinPartitions(*keys), "ordered")
    name = F.col("_metadata.file_name")
    # Part files are numbered in the order of the ranges.
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint")
    return rows.select("*", part.alias("part"), name.alias("file"), F.col("_metadata.row_index").alias("at"))


def numbered(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, depth, v1, v2, chars): every turn with its depth from 1, hashes and length."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("v1"),
        F.xxhash64(F.lit(1), *said).alias("v2"),
        F.length(said[1]).cast("bigint").alias("chars"),
    )
    rows = _place(rows, "conv_id", "turn", "v1", "v2")
    # A conversation has a row here for each file that holds some of it.
    spans = rows.groupBy("conv_id", "part", "file").agg(F.min("at").alias("first"), F.count("at").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("conv_id").alias("id"),
        F.col("file").alias("in_file"),
        (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first") + 1).alias("before"),
    )
    return rows.join(spans, (F.col("file") == F.col("in_file")) & (F.col("conv_id") == F.col("id"))).select(
        "conv_id", (F.col("at") + F.col("before")).alias("depth"), "v1", "v2", "chars"
    )


def regrafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation's first few are those of its family's first one; and all lengths.

    `crc32 of the id % MOST_SHARED` turns are replaced, by fewer if there are fewer.
    """
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("depth").alias("size"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("size").alias("head_size"))
    convs = (
        sizes.withColumns({"first": F.col("conv_id") - F.col("conv_id") % FAMILY, "shared": shared})
        .join(heads, F.col("first") == F.col("head"), "left")
        .withColumn("taken", F.least("shared", F.coalesce("head_size", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("shared"), F.lit(0)))
        .select("conv_id", "first", "shared", "taken", "length")
    )
    convs = written(convs, "conversations")
    # How far a conversation's turns move depends on the few of it that go, at most six values.
    moved = convs.where("shared <> taken").select(F.col("conv_id").alias("id"), "taken")
    own = turns.where(F.col("depth") > shared).join(moved, F.col("conv_id") == F.col("id"), "left")
    own = own.withColumn("depth", F.col("depth") - F.coalesce(shared - F.col("taken"), F.lit(0)))
    begin = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("depth") < MOST_SHARED))
    begin = begin.withColumnRenamed("conv_id", "head")
    taken = convs.join(begin, (F.col("first") == F.col("head")) & (F.col("depth") <= F.col("taken")))
    columns = ["conv_id", "depth", "v1", "v2", "chars"]
    return own.select(columns).unionByName(taken.select(columns)), convs.select("conv_id", "length")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """A row for every block of a conversation, with the hashes of all before it and up to its end."""
    k = F.floor((F.col("depth") - 1) / block)
    own = F.struct("depth", F.xxhash64("depth", "v1").alias("v1"), F.xxhash64("depth", "v2").alias("v2"), "chars")
    rows = (
        turns.select("conv_id", k.alias("k"), own.alias("turn"))
        .groupBy("conv_id", "k")
        .agg(
            F.bit_xor("turn.v1").alias("x1"),
            F.bit_xor("turn.v2").alias("x2"),
            F.sum("turn.chars").alias("chars"),
            F.sort_array(F.collect_list("turn")).alias("turns"),
        )
        .withColumn("stretch", F.floor(F.col("k") / STRETCH))
    )
    rows = written(rows, "blocks")

    def so_far(window, *extra: str) -> list[Column]:
        sums = (F.bit_xor("x1"), F.bit_xor("x2"), F.sum("chars"))
        return [F.coalesce(s.over(window), F.lit(0)).alias(n) for s, n in zip(sums, extra)]

    stretches = rows.groupBy("conv_id", "stretch").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("chars").alias("chars")
    )
    all_before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        F.col("conv_id").alias("id"), F.col("stretch").alias("nth"), *so_far(all_before, "s1", "s2", "s_chars")
    ).where("nth > 0")
    before = Window.partitionBy("conv_id", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", *so_far(before, "n1", "n2", "n_chars"))
    joined = near.join(stretches, (F.col("conv_id") == F.col("id")) & (F.col("stretch") == F.col("nth")), "left")
    zero = F.lit(0).cast("bigint")
    q1 = F.col("n1").bitwiseXOR(F.coalesce("s1", zero))
    q2 = F.col("n2").bitwiseXOR(F.coalesce("s2", zero))
    return joined.select(
        "conv_id", "k", "turns", q1.alias("q1"), q2.alias("q2"),
        q1.bitwiseXOR(F.col("x1")).alias("p1"), q2.bitwiseXOR(F.col("x2")).alias("p2"),
        (F.col("n_chars") + F.coalesce("s_chars", zero)).alias("before"), "chars",
    )


def _turn_rows(kids: DataFrame) -> DataFrame:
    """A row for every turn of the blocks: the hash up to it and without it, and the characters before it."""

    def up_to(start: str, value: str, n: Column) -> Column:
        part = F.transform(F.slice("turns", F.lit(1), n), lambda t: t[value])
        return F.aggregate(part, F.col(start), lambda total, x: total.bitwiseXOR(x))

    def row(turn: Column, i: Column) -> Column:
        chars = F.transform(F.slice("turns", F.lit(1), i), lambda t: t["chars"])
        return F.struct(
            turn["depth"].alias("depth"),
            up_to("q1", "v1", i + 1).alias("d1"), up_to("q2", "v2", i + 1).alias("d2"),
            up_to("q1", "v1", i).alias("e1"), up_to("q2", "v2", i).alias("e2"),
            F.aggregate(chars, F.col("before"), lambda total, x: total + x).alias("before"),
        )

    kept = [c for c in kids.columns if c not in ("k", "turns", "q1", "q2", "p1", "p2", "before")]
    return kids.select(*kept, F.explode(F.transform("turns", row)).alias("node")).select(*kept, "node.*")


def _nodes(kids: DataFrame, *sums: str) -> DataFrame:
    """Nodes of the turns of blocks: block by block, and by hash only where the trie forks."""
    rows = _turn_rows(kids)
    made = ["depth", "d1", "d2", "e1", "e2", "before", "owner", *sums]
    fine = (
        rows.where("forked")
        .groupBy("depth", "d1", "d2")
        .agg(
            # A prefix has one prefix before it.
            *[F.min(c).alias(c) for c in ("e1", "e2", "before", "owner")],
            *[F.sum(c).alias(c) for c in sums],
        )
    )
    return rows.where("NOT forked").select(made).unionByName(fine.select(made))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of every class in order, joined by commas; a string at a time."""
    key, digest, ends = None, None, 0
    names = ["length", "f1", "f2"]

    def out() -> pa.RecordBatch:
        row = [*key, ends, digest.hexdigest()]
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds)], [*names, "ends", "ends_sha256"]
        )

    for batch in batches:
        columns = [batch[name].to_pylist() for name in (*names, "ids", "size")]
        done = []
        for *found, ids, size in zip(*columns):
            if found == key:
                digest.update(b",")
            else:
                if key:
                    done.append(out())
                key, digest, ends = found, hashlib.sha256(), 0
            digest.update(ids.encode())
            ends += size
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else []
    if key:
        yield out()


def _classes(tails: DataFrame) -> DataFrame:
    """(length, f1, f2, ends, ends_sha256) of the conversations that are equal as a whole."""
    keys = ["length", "f1", "f2"]
    rows = _place(tails.select(*keys, "conv_id"), *keys, "conv_id")
    # Strings of ids in order, of bounded length however many conversations are equal.
    some = (
        rows.groupBy(*keys, "part", "file", F.floor(F.col("at") / IDS).alias("nth"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(
            *keys,
            F.col("ids")[0].alias("least"),
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
            F.size("ids").cast("bigint").alias("size"),
        )
    )
    kind = "length bigint, f1 bigint, f2 bigint, ends bigint, ends_sha256 string"
    return some.repartition(*keys).sortWithinPartitions(*keys, "least").mapInArrow(_digest, kind)


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of `turns` (conv_id, depth, v1, v2, chars) of `convs` (conv_id, length).

    Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256; `conv_id` and `depth` are its key.
    """
    first = convs.agg(F.min("conv_id")).first()[0]
    blocks = written(_blocks(turns, block), "blocks")
    key = ["k", "q1", "q2", "p1", "p2"]
    kids = blocks.groupBy(key).agg(
        F.count("conv_id").alias("n"),
        F.min("conv_id").alias("owner"),
        F.first("turns").alias("turns"),
        F.min("before").alias("before"),
    )
    kids = written(kids, "kids")
    # Behind the root all first blocks meet; elsewhere, where several blocks follow one prefix.
    forks = kids.where("k > 0").groupBy("k", "q1", "q2").agg(F.count("n").alias("ways")).where("ways > 1")
    later = kids.where("k > 0").join(forks, ["k", "q1", "q2"], "left")
    kids = later.withColumn("forked", F.col("ways").isNotNull()).drop("ways").unionByName(
        kids.where("k = 0").withColumn("forked", F.lit(True))
    )
    kids = written(kids, "kids")
    nodes = written(_nodes(kids, "n"), "nodes")

    where = F.struct("depth", "e1", "e2", "before")
    entries = nodes.groupBy("owner").agg(F.min(where).alias("entry")).select("owner", "entry.*")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("owner").alias("parent")
    )
    entries = (
        entries.where("depth > 1")
        .join(parents, ["depth", "e1", "e2"])
        .unionByName(entries.where("depth = 1").withColumn("parent", F.lit(first).cast("bigint")))
        .select(F.col("owner").alias("id"), F.col("depth").alias("entry"), "before", "parent")
    )
    entries = written(entries, "entries")

    last = blocks.select(
        "conv_id", (F.col("k") * block + F.size("turns")).alias("length"), F.col("p1").alias("f1"),
        F.col("p2").alias("f2"), (F.col("before") + F.col("chars")).alias("total"),
    )
    ends_here = convs.where("length > 0").select(F.col("conv_id").alias("id"), F.col("length").alias("whole"))
    zero = F.lit(0).cast("bigint")
    turnless = convs.where("length = 0").select(
        "conv_id", "length", zero.alias("f1"), zero.alias("f2"), zero.alias("total")
    )
    tails = last.join(ends_here, (F.col("conv_id") == F.col("id")) & (F.col("length") == F.col("whole")))
    tails = written(tails.select("conv_id", "length", "f1", "f2", "total").unionByName(turnless), "tails")
    at_end = nodes.select(F.col("depth").alias("length"), F.col("d1").alias("f1"), F.col("d2").alias("f2"), "owner", "n")
    root = convs.agg(F.min("conv_id").alias("owner"), F.count("conv_id").alias("n")).select(
        zero.alias("length"), zero.alias("f1"), zero.alias("f2"), "owner", "n"
    )
    classes = written(_classes(tails).join(at_end.unionByName(root), ["length", "f1", "f2"]), "classes")

    leaves = classes.where("n = ends").select(F.col("owner").alias("of"), F.lit(1).cast("bigint").alias("leaf"))
    info = tails.join(entries, F.col("conv_id") == F.col("id"), "left").join(leaves, F.col("conv_id") == F.col("of"), "left")
    # Characters before the turns that only this conversation has to store.
    info = info.select(
        F.col("conv_id").alias("member"),
        F.coalesce("leaf", zero).alias("leaves"),
        F.coalesce("before", "total").alias("held"),
        F.struct(
            "conv_id", F.coalesce("before", "total").alias("held"), "length", "entry", "parent",
        ).alias("owner"),
    )
    info = written(info, "members")
    sums = (
        blocks.select("conv_id", *key)
        .join(info, F.col("conv_id") == F.col("member"))
        .groupBy(key)
        .agg(F.sum("leaves").alias("leaves"), F.sum("held").alias("held"), F.min("owner").alias("owner"))
    )
    below = _nodes(kids.drop("owner").join(sums, key), "n", "leaves", "held")
    everyone = info.agg(
        F.min("owner").alias("owner"),
        F.count("member").alias("n"),
        F.sum("leaves").alias("leaves"),
        F.sum("held").alias("held"),
    ).where("n > 0")
    columns = ["depth", "before", "owner", "n", "leaves", "held"]
    whole = below.select(columns).unionByName(
        everyone.select(zero.alias("depth"), zero.alias("before"), "owner", "n", "leaves", "held")
    )
    children = entries.where("id <> parent").groupBy(F.col("parent").alias("id"), (F.col("entry") - 1).alias("at"))
    children = children.agg(F.count("entry").alias("more"), F.lit(None).cast("string").alias("ends_sha256"))
    ends = classes.select(F.col("owner").alias("id"), F.col("length").alias("at"), zero.alias("more"), "ends_sha256")
    beside = children.unionByName(ends).groupBy("id", "at")
    beside = beside.agg(F.sum("more").alias("more"), F.max("ends_sha256").alias("ends_sha256"))
    joined = whole.join(beside, (F.col("owner.conv_id") == F.col("id")) & (F.col("depth") == F.col("at")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    parent = F.when(F.col("depth") > F.col("owner.entry"), F.col("owner.conv_id")).otherwise(F.col("owner.parent"))
    return joined.select(
        F.col("owner.conv_id").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        ((F.col("owner.length") > F.col("depth")).cast("bigint") + F.coalesce("more", zero)).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("held") - F.col("owner.held") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
