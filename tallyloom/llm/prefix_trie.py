"""Z-fast trie of conversations: the prefixes that conversations share.

A prefix is known by its hash, an xor over turns of hashes of position and content, so the hashes of all prefixes are
running values, however long a conversation is. The trie is compacted: a node is where a conversation ends or where
conversations part, and its edge spans the depths from its parent's (not included) to its own. A node is stored under
the hash of its handle, the prefix at the two-fattest depth of its edge, the one divisible by the highest power of two.
A conversation finds the last node on its path by fat binary search: it looks for a node under its own prefix at the two-fattest
depth of what is left of its length, going on below the node if the node's whole extent is a prefix of it and
above that depth otherwise, so a path of length n costs about log n look-ups. What follows that node is its exit: no edge
with its next turn, or an edge that it leaves, or ends in, half way.

Conversations are inserted in batches. A batch is one conversation of all those that leave the trie at the same place
with the same next turn; edges are cut where any conversation leaves them, and the others go on from there in the next
round. Equal conversations are inserted once. At the end edges are expanded to one node per depth.

Every look-up is a join by hash, prefixes are held in arrays of ``CHUNK``, and figures of subtrees are summed over
ancestors at distances 1, 2, 4 and so on, so neither a very long conversation nor a deep or a bushy trie meets a single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.scan import along
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import written

#: prefixes that a row holds
CHUNK = 64
#: ids of members that a row holds, on the way to their digest
IDS = 256
#: conversations that share a base, and how many of its turns they take at most plus one
FAMILY, HEADS = 5, 9
ROOT = ""
NODE = "rep long, p long, e long, id string, parent string, name string, handle string, low_bytes long, all_bytes long"


# -- conversations ------------------------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content (digest of role and text), bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256).alias("content"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def heads_of(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their turns (conv_id, pos, content, bytes) after the exchange of their first ones."""
    numbered = along(written(turns, "turns"), ["conv_id"], ["turn", "content"], "nth")
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = written(sizes.select("conv_id", "n", base.alias("base"), heads_of(F.col("conv_id")).alias("h")), "conversations")
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = convs.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("given"))
    heads = numbered.where(F.col("nth") < HEADS - 1).select(F.col("conv_id").alias("base"), F.col("nth").alias("pos"), "content", "bytes")
    taken = given.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "content", "bytes")
    own = hot_key_join(numbered, given.select("conv_id", "h", "given"), ["conv_id"], "inner", salted=False).where(F.col("nth") >= F.col("h"))
    own = own.select("conv_id", (F.col("given") + F.col("nth") - F.col("h")).alias("pos"), "content", "bytes")
    return convs.select("conv_id"), taken.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, and in order of depth: hs (hashes of prefixes), upto (bytes up to the depth), before (bytes up to the depth above)."""
    hashed = turns.withColumns({"a": F.xxhash64("pos", "content"), "b": F.xxhash64("content", "pos")})
    hashed = written(hashed.select("conv_id", "pos", "bytes", "a", "b"), "hashed")
    run = along(hashed, ["conv_id"], ["pos"], "_nth", {"x": ("xor", "a"), "y": ("xor", "b"), "upto": ("sum", "bytes")})
    whole = F.concat_ws("-", F.hex("x"), F.hex("y")).alias("h")
    row = F.struct("pos", whole, "upto", (F.col("upto") - F.col("bytes")).alias("before"))
    grouped = run.groupBy("conv_id", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return written(grouped.select("conv_id", "chunk", F.col("rows.h").alias("hs"), "rows.upto", "rows.before"), "prefixes")


class Paths:
    """Hashes and bytes of the prefixes of conversations, by depth."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks
        facts = chunks.agg(F.max("chunk"), F.max(F.col("chunk") * CHUNK + F.size("hs"))).first()
        #: whether any conversation fills more than its first row
        self.long = bool(facts[0])
        self.longest: int = facts[1] or 0

    def carry(self, rows: DataFrame, who: str) -> DataFrame:
        """The first row of each conversation, as column ``_near``."""
        near = self.chunks.where("chunk = 0").select(F.col("conv_id").alias(who), F.struct("hs", "upto").alias("_near"))
        return rows.join(near, who, "left")

    def at(self, rows: DataFrame, who: str, depth: Column, into: str, what: str = "hs") -> DataFrame:
        """Add what the conversation has at a depth, null where the depth is null; rows carry ``_near``."""
        start = F.lit(ROOT) if what == "hs" else F.lit(0).cast("long")
        near = F.get(F.col("_near")[what], (depth - 1).cast("int"))
        if not self.long:
            return rows.withColumn(into, F.when(depth == 0, start).otherwise(near))
        keyed = rows.withColumns({"_depth": depth, "_chunk": F.floor((depth - 1) / CHUNK).cast("long")})
        far = self.chunks.where("chunk > 0").select(F.col("conv_id").alias("_who"), F.col("chunk").alias("_of"), F.col(what).alias("_far"))
        joined = keyed.join(far, (F.col(who) == F.col("_who")) & (F.col("_chunk") == F.col("_of")), "left")
        beyond = F.get("_far", ((F.col("_depth") - 1) % CHUNK).cast("int"))
        value = F.when(F.col("_depth") == 0, start).when(F.col("_depth") <= CHUNK, near).otherwise(beyond)
        return joined.withColumn(into, value).drop("_depth", "_chunk", "_who", "_of", "_far")


# -- the trie -----------------------------------------------------------------------------------------------------------


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides; null if there is none."""
    power = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.when(low < high, high.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), power)))


def locate(waiting: DataFrame, nodes: DataFrame, paths: Paths) -> DataFrame:
    """conv, len, lcp (the depth of the longest prefix in the trie), and the edge that is left or ended in half way, if any.

    ``waiting``: conv, len, lo (depth of a node on its path), _near.
    """
    rows = waiting.withColumn("hi", F.col("len"))
    stored = nodes.select("handle", F.col("e").alias("_e"), F.col("id").alias("_id"))
    for _ in range(paths.longest.bit_length()):
        rows = rows.withColumn("_f", two_fattest(F.col("lo"), F.col("hi")))
        rows = paths.at(rows, "conv", F.col("_f"), "handle")
        rows = hot_key_join(rows, stored, ["handle"], "left", salted=False)
        rows = paths.at(rows, "conv", F.when(F.col("_e") <= F.col("len"), F.col("_e")), "_own")
        passed = F.coalesce(F.col("_own") == F.col("_id"), F.lit(False))
        rows = rows.withColumns(
            {
                "lo": F.when(passed, F.col("_e")).otherwise(F.col("lo")),
                "hi": F.when(passed | F.col("_f").isNull(), F.col("hi")).otherwise(F.col("_f") - 1),
            }
        ).drop("handle", "_e", "_id", "_own", "_f")
    rows = paths.at(rows, "conv", F.when(F.col("lo") < F.col("len"), F.col("lo") + 1), "name")
    edges = nodes.select("name", F.col("id").alias("c_id"), F.col("rep").alias("c_rep"), F.col("p").alias("c_p"), F.col("e").alias("c_e"))
    return written(hot_key_join(rows, edges, ["name"], "left", salted=False).select("conv", "len", "lo", "c_id", "c_rep", "c_p", "c_e"), "exits")


def parting(exits: DataFrame, paths: Paths) -> DataFrame:
    """Add lcp: how far each conversation follows its exit edge, compared row by row of prefixes with one that has the whole edge."""
    on_edge = exits.where("c_id is not null").withColumn("_to", F.least("len", "c_e"))
    rows = on_edge.select("conv", "c_rep", "lo", "_to", F.explode(F.expr(f"sequence(lo div {CHUNK}, (_to - 1) div {CHUNK})")).alias("chunk"))
    own = paths.chunks.select(F.col("conv_id").alias("conv"), "chunk", F.col("hs").alias("_own"))
    other = paths.chunks.select(F.col("conv_id").alias("c_rep"), "chunk", F.col("hs").alias("_other"))
    both = hot_key_join(rows.join(own, ["conv", "chunk"]), other, ["c_rep", "chunk"], "inner", salted=False)
    base = F.col("chunk") * CHUNK
    inside = F.filter(
        F.zip_with("_own", "_other", lambda x, y: x == y), lambda same, i: same & (base + i >= F.col("lo")) & (base + i < F.col("_to"))
    )
    alike = both.groupBy("conv").agg(F.sum(F.size(inside)).alias("_more"))
    return exits.join(alike, "conv", "left").withColumn("lcp", F.col("lo") + F.coalesce("_more", F.lit(0))).drop("_more")


def as_nodes(edges: DataFrame, paths: Paths) -> DataFrame:
    """Nodes of edges (rep, p, e): the hashes of their ends, name and handle, and the bytes above and at their ends."""
    rows = paths.carry(edges, "rep")
    for into, depth in (("id", F.col("e")), ("parent", F.col("p")), ("name", F.col("p") + 1), ("handle", two_fattest(F.col("p"), F.col("e")))):
        rows = paths.at(rows, "rep", depth, into)
    for into, depth in (("low_bytes", F.col("p")), ("all_bytes", F.col("e"))):
        rows = paths.at(rows, "rep", depth, into, "upto")
    return rows.select(*[field.split()[0] for field in NODE.split(", ")])


def build(sequences: DataFrame, paths: Paths) -> DataFrame:
    """Nodes of the compacted trie but for its root. ``sequences``: conv, len of distinct conversations with turns."""
    nodes = sequences.sparkSession.createDataFrame([], NODE)
    waiting = written(sequences.select("conv", "len", F.lit(0).cast("long").alias("lo")), "waiting")
    while not waiting.isEmpty():
        found = written(parting(locate(paths.carry(waiting, "conv"), nodes, paths), paths), "partings")
        cut = found.where("c_id is not null").select("c_id", "c_rep", "c_p", "c_e", F.col("lcp").alias("e")).distinct()
        ends = cut.select("c_id", "c_rep", "c_p", "c_e", F.col("c_e").alias("e")).distinct()
        above = F.lag("e").over(Window.partitionBy("c_id").orderBy("e"))
        pieces = cut.union(ends).select(F.col("c_rep").alias("rep"), F.coalesce(above, F.col("c_p")).alias("p"), "e")
        on = paths.at(paths.carry(found.where("len > lcp"), "conv"), "conv", F.col("lcp") + 1, "next")
        first = on.groupBy("next").agg(F.min(F.struct("conv", "lcp", "len")).alias("first")).select("first.*")
        batch = written(first, "batch")
        fresh = as_nodes(pieces.union(batch.select("conv", "lcp", "len")), paths)
        kept = nodes.join(ends.select(F.col("c_id").alias("id")), "id", "left_anti").select(*nodes.columns)
        nodes = written(kept.union(fresh), "nodes")
        others = found.where("len > lcp").join(batch.select("conv"), "conv", "left_anti")
        waiting = written(others.select("conv", "len", F.col("lcp").alias("lo")), "waiting")
    return nodes


# -- figures ------------------------------------------------------------------------------------------------------------


def member_digests(members: DataFrame) -> DataFrame:
    """id, ends_sha256: digest of the decimal conv_ids, ascending, with commas between. ``members``: id, conv_id.

    Ids are ranked and joined to texts of ``IDS`` in parallel. The texts of one id are fed to its digest in order, which
    only one task can do, row by row without holding them.
    """
    ranked = along(written(members, "members"), ["id"], ["conv_id"], "nth")
    pieces = ranked.groupBy("id", F.expr(f"nth div {IDS}").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and key == current:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["id", "ends_sha256"])
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    return pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "ids").mapInArrow(run, "id string, ends_sha256 string")


SUMS = ("n", "leaves", "spent", "held")


def subtrees(tree: DataFrame) -> DataFrame:
    """``tree`` with the SUMS of each node summed and ``low`` minimised over its subtree; columns id, parent and these.

    In round k a node knows the figures of its descendants nearer than 2^k, and adds those of the nodes whose ancestor at
    distance 2^k it is.
    """
    rows = written(tree.withColumn("above", F.col("parent")), "subtrees")
    while not rows.where("above is not null").isEmpty():
        added = rows.where("above is not null").groupBy(F.col("above").alias("id")).agg(
            *[F.sum(c).alias(f"_{c}") for c in SUMS], F.min("low").alias("_low")
        )
        further = rows.select(F.col("id").alias("above"), F.col("above").alias("_above"))
        moved = hot_key_join(rows, further, ["above"], "left", salted=False)
        both = moved.join(added, "id", "left")
        figures = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS]
        rows = written(both.select("id", "parent", F.col("_above").alias("above"), *figures, F.least("low", "_low").alias("low")), "subtrees")
    return rows.drop("above")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node of every depth.

    Rows with a null conv_id take no part. A null turn comes first, equal turns in order of a digest of their role and
    text; null roles and texts are empty ones. Repeated rows are repeated turns. Without conversations there is no node,
    not even the root. Prefixes are told apart by 128 bits of hash. Other columns are not carried on.
    """
    convs, turns = rebuilt(turns_of(conversations))
    paths = Paths(prefixes(turns))
    last = paths.chunks.groupBy("conv_id").agg(
        F.max(F.struct("chunk", F.element_at("hs", -1).alias("h"), F.size("hs").alias("size"))).alias("last")
    )
    ends = convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.h", F.lit(ROOT)).alias("id"), F.coalesce(F.col("last.chunk") * CHUNK + F.col("last.size"), F.lit(0)).alias("len")
    )
    ends = written(ends, "ends")
    classes = ends.groupBy("id", "len").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    nodes = build(classes.where("len > 0").select("conv", "len"), paths)

    everything = convs.agg(F.min("conv_id").alias("rep")).where("rep is not null")
    nothing, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    root = everything.select("rep", zero.alias("p"), zero.alias("e"), F.lit(ROOT).alias("id"), nothing.alias("parent"), *[nothing.alias(n) for n in ("name", "handle")], *[zero.alias(n) for n in ("low_bytes", "all_bytes")])
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    known = nodes.union(root).join(children, "id", "left").join(classes.select("id", F.col("conv").alias("low"), F.col("n").alias("own")), "id", "left")
    known = known.select("id", "parent", "rep", "p", "e", "low_bytes", "all_bytes", F.coalesce("children", zero).alias("children"), "low", F.coalesce("own", zero).alias("n"))
    known = written(known, "known")
    span = F.col("all_bytes") - F.col("low_bytes")
    own = known.select("id", "parent", "low", "n", (F.col("children") == 0).cast("long").alias("leaves"), (F.col("n") * F.col("all_bytes")).alias("spent"), span.alias("held"))
    figures = subtrees(own)
    lows = figures.select(F.col("id").alias("parent"), F.col("low").alias("parent_low"))
    whole = known.drop("low", "n", "parent").join(hot_key_join(figures, lows, ["parent"], "left", salted=False), "id")
    whole = written(whole.join(member_digests(ends.select("id", "conv_id")), "id", "left"), "figures")
    return expanded(whole, paths)


def expanded(nodes: DataFrame, paths: Paths) -> DataFrame:
    """One row per depth of every edge. What a subtree saves: bytes of all its members' turns below the depth above, less what is held once."""
    empty = hashlib.sha256().hexdigest()
    spread = nodes.withColumn("chunk", F.explode(F.expr(f"sequence(p div {CHUNK}, greatest(e - 1, 0) div {CHUNK})")))
    joined = spread.join(paths.chunks.select(F.col("conv_id").alias("rep"), "chunk", "before"), ["rep", "chunk"], "left")
    base = F.col("chunk") * CHUNK
    above = F.when(F.col("e") == 0, F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before")))).otherwise(
        F.filter(
            F.transform("before", lambda b, i: F.struct((base + i + 1).alias("depth"), b.alias("before"))),
            lambda r: (r["depth"] > F.col("p")) & (r["depth"] <= F.col("e")),
        )
    )
    rows = joined.withColumn("_row", F.explode(above)).drop("before").select("*", "_row.*")
    at_end, at_start = F.col("depth") == F.col("e"), F.col("depth") == F.col("p") + 1
    saved = F.col("spent") - F.col("n") * F.col("before") - (F.col("held") - (F.col("before") - F.col("low_bytes")))
    return rows.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(at_start, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_end, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(empty))).otherwise(empty).alias("ends_sha256"),
    )
