"""Prefix tries of conversations by burst tries (operator 13).

A conversation is a string of turn ids, and a node of the trie is a common prefix. Equal conversations are one entry with a
number of copies. An entry is cut into slabs of a bounded number of turns; slabs that are equal and come after equal prefixes
are one suffix, held in the container of the trie head that the prefix ends in. A container with too many suffixes bursts: its
suffixes move on to heads one turn deeper, by their next turn id, until no container is oversized. What remains is dealt out by
head, sorted, and swept: suffixes next to each other share the nodes of their common prefix.

The sweep tells each suffix the nodes on its way: each node's smallest member, which together with the depth is its name, and
its number of members. An entry owns the nodes that are named after it; every other node on its way belongs to an earlier
one. Sums over subtrees are therefore one aggregation of rows (node on an entry's way, what the entry owns from there on), with
map-side combine; there are as many rows as turns, and no path, however long, is held in one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlog.llm.common import bounded_batches, written

#: Turns of one suffix.
SLAB = 64

#: Suffixes of a container before it bursts.
CONTAINER = 1024

#: Ids that are joined in one cell on the way to the digest of a node's conversations.
CHUNK = 16384

#: monotonically_increasing_id() keeps the row's place in its partition below this bit.
_ROW_BITS = 33


def ordered_turns(
    df: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``place`` from 1, ``turn_id`` and ``size`` (UTF-8 bytes of the text) of every turn.

    Turns are in the order of their numbers, null first; equal numbers go by role, then text. Null roles and texts count as
    empty. Rows without a conversation are left out. Repeated rows are turns of their own. A conversation may hold any share
    of the rows: rows are sorted by ranges, and a place is the row's place among all, less that of the conversation's first.
    """
    names = ["conv_id", "turn", "role", "text"]
    values = [
        F.col(id_column).cast("long"),
        F.col(turn),
        F.coalesce(F.col(role), F.lit("")),
        F.coalesce(F.col(text), F.lit("")),
    ]
    rows = df.select(*[v.alias(n) for v, n in zip(values, names, strict=True)], F.monotonically_increasing_id().alias("row"))
    rows = rows.filter(F.col("conv_id").isNotNull())
    # The row's own number only separates repeated rows, of which there may be many.
    rows = rows.repartitionByRange(*names, "row").sortWithinPartitions(*names, "row")
    turn_id = F.unhex(F.md5(F.concat_ws(":", F.char_length("role"), "role", "text")))
    rows = rows.select("conv_id", turn_id.alias("turn_id"), F.octet_length("text").cast("long").alias("size"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "turns")

    part = F.shiftright("at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    # One row per range; their number is a setting, not the size of the data.
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part")
    placed = placed.withColumn("at", F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1))
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("place"), "turn_id", "size")


def _mark(seed: int) -> Column:
    """A hash of a turn at its depth; those of a prefix are put together by exclusive or."""
    return F.xxhash64(F.lit(seed), "depth", "turn_id")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in the order of their container and ids; each gets the smallest member and the members of its nodes."""

    def sweep(rows: list[dict]) -> pa.RecordBatch:
        ways, way, last = [], [], []
        for row in rows:
            ids = row["ids"][row["taken"] :]
            same = 0
            while same < min(len(ids), len(last)) and ids[same] == last[same]:
                same += 1
            way = way[:same] + [[row["low"], 0] for _ in ids[same:]]
            for node in way:
                node[0] = min(node[0], row["low"])
                node[1] += row["n"]
            ways.append(way)
            last = ids
        for row, nodes in zip(rows, ways, strict=True):
            row["lows"] = row["lows"] + [low for low, _ in nodes]
            row["ns"] = row["ns"] + [n for _, n in nodes]
        return pa.RecordBatch.from_pylist([{n: row[n] for n in _NODES.names} for row in rows], _NODES)

    held, head = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["slab"], row["k1"], row["k2"]
            if key != head and held:
                yield sweep(held)
                held = []
            head = key
            held.append(row)
    if held:
        yield sweep(held)


_KEY = ["slab", "h1", "h2", "x1", "x2"]
_NODES = pa.schema(
    [(n, pa.int64()) for n in _KEY] + [("sizes", pa.list_(pa.int64())), ("lows", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))]
)
_NODES_DDL = ", ".join(f"{n} bigint" for n in _KEY) + ", sizes array<bigint>, lows array<bigint>, ns array<bigint>"


def _burst(suffixes: DataFrame, slab: int, container: int) -> DataFrame:
    """Suffixes with the nodes on their way (``_NODES``)."""
    none = F.array().cast("array<bigint>")
    held = suffixes.select(
        "*", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(0).alias("taken"), none.alias("lows"), none.alias("ns")
    )
    names, found = held.columns, None
    while True:
        heads = held.groupBy("slab", "k1", "k2").agg(
            F.count("*").alias("rows"), F.min("low").alias("head_low"), F.sum("n").alias("head_n")
        )
        heads = written(heads, "trie-heads")
        # A head made by bursting is a node; a slab's first head is one of the slab before.
        known = held.join(heads, ["slab", "k1", "k2"])
        for name, value in (("lows", "head_low"), ("ns", "head_n")):
            known = known.withColumn(name, F.when(F.col("taken") > 0, F.array_append(name, F.col(value))).otherwise(F.col(name)))
        done = (F.col("rows") <= container) | (F.col("taken") == F.size("ids"))
        small = known.filter(done).select(*names)
        found = small if found is None else found.unionByName(small)
        if heads.filter(F.col("rows") > container).isEmpty():
            break
        depth = F.col("slab") * slab + F.col("taken") + 1
        big = known.filter(~done).select(*names).withColumns({"depth": depth, "turn_id": F.get("ids", F.col("taken"))})
        moved = {"k1": F.col("k1").bitwiseXOR(_mark(1)), "k2": F.col("k2").bitwiseXOR(_mark(2)), "taken": F.col("taken") + 1}
        held = written(big.withColumns(moved).select(*names), "burst-suffixes")
    swept = found.repartition("slab", "k1", "k2").sortWithinPartitions("slab", "k1", "k2", "ids").mapInArrow(_swept, _NODES_DDL)
    return written(swept, "swept-suffixes")


def _joined(chunk: int):
    """Sorted ids of a node's conversations as texts of at most so many ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, ids = [], None, []

        def end_chunk() -> None:
            if ids:
                rows.append({"conv_id": key[0], "depth": key[1], "first": ids[0], "ids": ",".join(map(str, ids))})
                ids.clear()

        for batch in batches:
            for low, depth, conv in zip(*(batch.column(n).to_pylist() for n in ("low", "depth", "conv_id")), strict=True):
                if key != (low, depth) or len(ids) >= chunk:
                    end_chunk()
                key = low, depth
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)
            rows.clear()
        end_chunk()
        yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    return join


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the chunks of a node, which come in order."""
    rows, key, digest = [], None, None

    def end_node() -> None:
        if key is not None:
            rows.append({"conv_id": key[0], "depth": key[1], "ends_sha256": digest.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["conv_id"], row["depth"]):
                end_node()
                key, digest = (row["conv_id"], row["depth"]), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["ids"].encode())
        yield pa.RecordBatch.from_pylist(rows, _DIGESTS)
        rows.clear()
    end_node()
    yield pa.RecordBatch.from_pylist(rows, _DIGESTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
_CHUNKS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _ends(ends: DataFrame, chunk: int) -> DataFrame:
    """``conv_id``, ``depth``, ``ends_sha256`` of the nodes in which conversations end (``low``, ``depth``, ``conv_id``)."""
    order = ["low", "depth", "conv_id"]
    ends = written(ends.select(*order), "ends")
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = chunks.mapInArrow(_joined(chunk), "conv_id bigint, depth bigint, first bigint, ids string")
    chunks = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return chunks.mapInArrow(_digested, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, slab: int = SLAB, container: int = CONTAINER, chunk: int = CHUNK
) -> DataFrame:
    """One row per node of the trie of the conversations: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` has ``conv_id``, ``depth`` from 1 without gaps, ``turn_id`` (binary) and ``size``; ``convs`` every ``conv_id`` once
    with its ``length``, which may be zero. A node is a prefix; its ``conv_id`` is the smallest conversation that starts with it,
    ``parent_conv_id`` that of the prefix one turn shorter (null for the root). ``saved_tokens`` sums, over the subtree, the size
    of a node's last turn times the members beyond the first. ``ends_sha256`` is the digest of the ids that end in the node,
    ascending, joined by commas. No conversations give no rows, not even a root.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    if not total["n"]:
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        return spark.createDataFrame([], ", ".join(f"{n} bigint" for n in names) + ", ends_sha256 string")

    marked = turns.groupBy("conv_id").agg(F.bit_xor(_mark(1)).alias("m1"), F.bit_xor(_mark(2)).alias("m2"))
    known = convs.join(marked, "conv_id", "left").na.fill(0, ["m1", "m2"])
    known = written(known.select("conv_id", "length", "m1", "m2"), "conversations")
    entries = known.groupBy("length", "m1", "m2").agg(F.min("conv_id").alias("entry"), F.count("*").alias("copies"))
    entries = written(entries, "entries")
    first = entries.select(F.col("entry").alias("conv_id"), "copies", "length")

    # Slabs of the entries, with the mark of all turns before each.
    part = F.call_function("div", F.col("depth") - 1, F.lit(slab))
    turn = F.struct("depth", "turn_id", "size")
    slabs = turns.join(first.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", part.alias("slab")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.bit_xor(_mark(1)).alias("x1"), F.bit_xor(_mark(2)).alias("x2")
    )
    earlier = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select(
        "conv_id", "slab", F.col("turns.turn_id").alias("ids"), F.col("turns.size").alias("sizes"), "x1", "x2",
        *[F.coalesce(F.bit_xor(f"x{n}").over(earlier), F.lit(0)).alias(f"h{n}") for n in (1, 2)],
    )
    slabs = written(slabs, "slabs")
    suffixes = slabs.join(first.select("conv_id", "copies"), "conv_id").groupBy(*_KEY).agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("low"), F.sum("copies").alias("n")
    )
    nodes = _burst(written(suffixes, "suffixes"), slab, container)

    # Each entry's way, slab by slab from its end: what it owns from a node on, and what it meets across slabs.
    way = slabs.select("conv_id", *_KEY).join(nodes, _KEY).join(first, "conv_id")
    each = F.arrays_zip("lows", "ns", "sizes")
    value = F.transform(each, lambda t: F.when(t["lows"] == F.col("conv_id"), (t["ns"] - 1) * t["sizes"]).otherwise(F.lit(0).cast("long")))
    ends_here = F.col("slab") * slab + F.size("lows") == F.col("length")
    own_end = (F.element_at("lows", -1) == F.col("conv_id")) & (F.element_at("ns", -1) == F.col("copies"))
    way = way.withColumns(
        {
            "values": value,
            "sum": F.aggregate(value, F.lit(0).cast("long"), lambda a, b: a + b),
            "leaf": F.when(ends_here & own_end, 1).otherwise(0),
        }
    )
    back = Window.partitionBy("conv_id").orderBy(F.col("slab").desc())
    so_far = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    way = way.select(
        "conv_id", "slab", "lows", "ns", "values",
        (F.sum("sum").over(so_far)).alias("rest"),
        F.max("leaf").over(so_far).alias("leaf"),
        F.lag(F.get("lows", F.lit(0))).over(back).alias("next_low"),
        F.coalesce(F.lead(F.element_at("lows", -1)).over(back), F.lit(total["low"])).alias("before_low"),
    )
    way = way.select("*", F.posexplode("lows").alias("at", "low"))
    own = F.col("low") == F.col("conv_id")
    after = F.coalesce(F.get("lows", F.col("at") + 1), F.col("next_low"))
    before = F.when(F.col("at") == 0, F.col("before_low")).otherwise(F.get("lows", F.col("at") - 1))
    spent = F.aggregate(F.slice("values", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b)
    sums = way.groupBy(F.col("low").alias("conv_id"), (F.col("slab") * slab + F.col("at") + 1).alias("depth")).agg(
        F.max(F.when(own, before)).alias("parent_conv_id"),
        F.max(F.when(own, F.get("ns", F.col("at")))).alias("n_convs"),
        F.sum(F.when(after == F.col("conv_id"), 1).otherwise(0)).alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum(F.col("rest") - spent).alias("saved_tokens"),
    )
    sums = written(sums, "trie-nodes")

    # The root has no turn of its own: its sums are those of its children.
    children = sums.filter(F.col("depth") == 1).agg(
        F.count("*").alias("n_children"),
        F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    )
    root = children.select(
        F.lit(total["low"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens",
    )
    last = nodes.select(*_KEY, F.element_at("lows", -1).alias("low"))
    final = slabs.join(first, "conv_id").filter(F.col("slab") * slab + F.size("ids") == F.col("length"))
    last = final.select(F.col("conv_id").alias("entry"), *_KEY).join(last, _KEY).select("entry", "low")
    last = entries.join(last, "entry", "left").select("length", "m1", "m2", F.coalesce("low", F.lit(total["low"])).alias("low"))
    ends = known.join(last, ["length", "m1", "m2"]).select("low", F.col("length").alias("depth"), "conv_id")
    digests = _ends(ends, chunk)
    rows = sums.select(*root.columns).unionByName(root).join(digests, ["conv_id", "depth"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (with ``depth``) and lengths of conversations whose first turns are another's.

    A conversation c begins with the first h turns of conversation c - c % 5 (all of them, if there are fewer) and goes on with
    its own after its first h; h is the unsigned CRC-32 of its decimal id modulo 9.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    plan = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
                          (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = written(plan.select("conv_id", "n", "base", "h", "head"), "rebuilding")
    heads = turns.filter(F.col("place") <= 8).withColumnRenamed("conv_id", "base").join(plan, "base")
    heads = heads.filter(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("depth"), "turn_id", "size")
    rests = turns.join(plan, "conv_id").filter(F.col("place") > F.col("h"))
    rests = rests.select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "turn_id", "size")
    length = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return written(heads.unionByName(rests), "rebuilt-turns"), plan.select("conv_id", length.alias("length"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(ordered_turns(rows)))
