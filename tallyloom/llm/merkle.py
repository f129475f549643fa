"""Merkle manifest of a corpus with a proof for every row, by a butterfly exchange between partitions.

The leaves of a source are ranked by doc_id and cut into partitions, aligned runs of ``FANOUT`` ^ ``HEIGHT`` leaves, and
each partition hashes its own subtree. Then rounds follow. In round r, partitions whose numbers differ only in digit r
(to the base ``FANOUT``) swap the roots of their subtrees, and each of them hashes the common ancestor itself. What a
partition receives in a round are the siblings of its ancestor, so after the last round each holds its upper proof and
the root, and nothing has to be passed down again. A subtree at the right edge has fewer partitions than its siblings;
they stand in for those that are missing. The roots of the sources are swapped in the same way, each source's first
partition speaking for it and all of its partitions listening.

A digest is the lowercase hex text of SHA-256, and so is what is hashed. All steps are DataFrame functions. A partition
is a row with a bounded array; groups that swap have at most ``FANOUT`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scan import along
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import written

FANOUT = 16
#: levels of the tree inside one partition
HEIGHT = 3
TAMPERED_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(values: dict[str, Column]) -> Column:
    """Digest of the fields, each as its length in bytes, a colon and its text, or a dash for null."""
    texts = [values[n].cast("string") for n in FIELDS]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, the source as a key without nulls, leaf, and changed: the leaf of a row whose text was tampered with."""
    values = {n: F.col(n) for n in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    touched = leaf_of(values | {"text": F.translate("text", UPPER, LOWER)})
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNotNull().alias("named"),
        F.coalesce("source", F.lit("")).alias("source"),
        leaf_of(values).alias("leaf"),
        F.when(tampered, touched).alias("changed"),
    )


def _text(digests: Column) -> Column:
    return F.array_join(digests, "")


def _at_height(n: Column, height: int) -> Column:
    """How many nodes a tree of n leaves has at a height."""
    return F.ceil(n / F.lit(FANOUT**height)).cast("long")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: _digest(_text(F.slice(nodes, i * FANOUT + 1, FANOUT))))


def partitions(placed: DataFrame) -> DataFrame:
    """nth, n, part, rows (doc_id, leaf, changed in order), and the nodes of each height of the partition's subtree."""
    size = FANOUT**HEIGHT
    row = F.struct("pos", "doc_id", "leaf", "changed")
    found = placed.groupBy("nth", "n", F.floor(F.col("pos") / size).cast("long").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = found.withColumn("h0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(HEIGHT):
        nodes = F.col(f"h{k}")
        found = found.withColumn(f"h{k + 1}", F.when(_at_height(F.col("n"), k) > 1, _parents(nodes)).otherwise(nodes))
    return found


def exchange(state: DataFrame, tree: list[str], number: str, many: Column, most: int, speaks: Column | None = None) -> DataFrame:
    """Rounds between the partitions of each ``tree``: ``node`` becomes its root, and ``siblings`` grow by those on the way.

    ``number`` is a partition's number and ``many`` the number of partitions of its tree, at most ``most``. With ``speaks``, only such rows
    send, and all rows with a number listen. ``siblings`` is an array of structs (before, after): texts of digests.
    """
    round_no = 0
    while most > FANOUT**round_no:
        stride, group = FANOUT**round_no, FANOUT ** (round_no + 1)
        at, open_ = F.col(number), _at_height(many, round_no) > 1
        active = state.withColumns(
            {"_hi": F.floor(at / group).cast("long"), "_lo": at % stride, "_digit": (F.floor(at / stride) % FANOUT).cast("int"), "_open": open_}
        )
        # the partitions of this subtree: fewer than elsewhere at the right edge, where they send for the missing ones too
        width = F.least(F.lit(stride).cast("long"), many - F.floor(at / stride).cast("long") * stride)
        receivers = F.when((width < stride) & (F.col("_digit") > 0), F.sequence("_lo", F.lit(stride - 1).cast("long"), width)).otherwise(F.array("_lo"))
        senders = active.where("_open" if speaks is None else speaks & F.col("_open"))
        sent = senders.select(*tree, "_hi", F.explode(receivers).alias("_lo"), F.struct("_digit", "node").alias("sent"))
        swapped = sent.groupBy(*tree, "_hi", "_lo").agg(F.transform(F.array_sort(F.collect_list("sent")), lambda s: s["node"]).alias("_swapped"))
        met = hot_key_join(active, swapped, [*tree, "_hi", "_lo"], "left", salted=False)
        before, after = _text(F.slice("_swapped", F.lit(1), F.col("_digit"))), _text(F.slice("_swapped", F.col("_digit") + 2, F.lit(FANOUT)))
        grown = F.concat("siblings", F.array(F.struct(before.alias("before"), after.alias("after"))))
        state = met.withColumns(
            {
                "siblings": F.when(F.col("_open"), grown).otherwise(F.col("siblings")),
                "node": F.when(F.col("_open"), _digest(_text(F.col("_swapped")))).otherwise(F.col("node")),
            }
        ).select(*state.columns)
        state = written(state, f"round{round_no}")
        round_no += 1
    return state


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of ``docs``.

    Nulls are values of their own in a leaf. Null doc_ids come first in their source and are never tampered with. Rows
    with the same doc_id are ordered by leaf, so repeated rows stand side by side and each has its own proof. Texts are
    hashed whole. A null source is a source and comes first. An empty table has no rows. Other columns are not carried on.
    """
    found = written(leaves(docs), "leaves")
    ranked = along(found, ["named", "source"], ["doc_id", "leaf"], "pos")
    counted = written(ranked.groupBy("named", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1)), "sources")
    sources = along(counted, ["all"], ["named", "source"], "nth").select("named", "source", "n", "nth")
    sizes = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    return proven(ranked, sources, *sizes)


def proven(ranked: DataFrame, sources: DataFrame, n_sources: int, largest: int) -> DataFrame:
    """The rows of ``manifest`` from leaves with their places, and the sources with their sizes and places."""
    placed = hot_key_join(ranked, sources, ["named", "source"], "inner", salted=False).select("nth", "n", "pos", "doc_id", "leaf", "changed")
    parts = written(partitions(placed), "partitions")
    no_siblings = F.array().cast("array<struct<before:string,after:string>>")
    many = _at_height(F.col("n"), HEIGHT)
    state = parts.select("nth", "n", "part", F.col(f"h{HEIGHT}")[0].alias("node"), no_siblings.alias("siblings"))
    state = exchange(state, ["nth"], "part", many, -(-largest // FANOUT**HEIGHT))
    state = state.withColumns({"subroot": F.col("node"), "all": F.lit(1)})
    state = exchange(state, ["all"], "nth", F.lit(n_sources).cast("long"), n_sources, speaks=F.col("part") == 0)
    whole = parts.join(state.select("nth", "part", "subroot", F.col("node").alias("root"), "siblings"), ["nth", "part"])

    def row(r: Column, i: Column) -> Column:
        proof, folded, at = F.lit(""), F.coalesce(r["changed"], r["leaf"]), i
        for k in range(HEIGHT):
            begin, digit = F.floor(at / FANOUT).cast("int") * FANOUT + 1, (at % FANOUT).cast("int")
            nodes, more = F.col(f"h{k}"), _at_height(F.col("n"), k) > 1
            before, after = _text(F.slice(nodes, begin, digit)), _text(F.slice(nodes, begin + digit + 1, FANOUT - 1 - digit))
            proof = F.when(more, F.concat(proof, before, after)).otherwise(proof)
            folded = F.when(more, _digest(F.concat(before, folded, after))).otherwise(folded)
            at = F.floor(at / FANOUT).cast("int")
        above = F.array_join(F.transform("siblings", lambda s: F.concat(s["before"], s["after"])), "")
        folded = F.aggregate("siblings", folded, lambda a, s: _digest(F.concat(s["before"], a, s["after"])))
        return F.struct(
            r["doc_id"].alias("doc_id"),
            r["leaf"].alias("leaf"),
            F.col("subroot").alias("subroot"),
            F.col("root").alias("root"),
            _digest(F.concat(proof, above)).alias("proof_sha256"),
            folded.alias("folded_root"),
        )

    out = whole.select(F.inline(F.transform("rows", row)))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
