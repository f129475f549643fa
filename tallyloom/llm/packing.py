"""Packing of tokenised documents into sequences of a fixed length by minimum bin slack.

1. Each document is encoded and cut into pieces of full length and a rest; the pieces are written to the shared folder.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the corpus. On it a plan is made: the longest
   length that is left opens a window, and a bitset subset-sum over the multiset of remaining lengths picks the filling
   closest to capacity, which is taken as many times as the counts allow; then the counts are reduced and so on.
3. Pieces are numbered within their length: within salted parts of it, with the sizes of the earlier parts added, so that
   a length shared by a third of all pieces is no single task. The number gives window and place by a search in the plan.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import load
from tallyloom.llm.common import map_batches, texts_of
from tallyloom.session import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_OF_TEXT = 1
#: pieces numbered by one task
PART_ROWS = 50_000


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_OF_TEXT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full pieces and the rest of each document, ``end_id`` included."""

    def step(batch):
        bpe = load(path)
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for key, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts_of(batch)), strict=True):
            raw = np.append(ids, end_id).astype("<u4")
            for at in range(0, len(raw), capacity):
                piece = raw[at : at + capacity]
                for name, value in zip(out, (key, at, len(piece), zlib.crc32(piece.tobytes()), len(raw)), strict=True):
                    out[name].append(value)
        yield out

    return map_batches(
        docs.select("doc_id", "text"), step, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


@dataclass(frozen=True)
class Pattern:
    """A filling of one window, used ``times`` times for the windows from ``first`` on."""

    first: int
    times: int
    lengths: tuple[tuple[int, int], ...]  # length, how often in one window


def fill(counts: dict[int, int], opener: int, capacity: int) -> dict[int, int]:
    """The multiset with ``opener`` in it that comes closest to the capacity.

    Bit s of the set says that the sum s can be made. Counts enter as groups of 1, 2, 4, … equal pieces; the set before
    each group is kept to trace the choice back. Stops at the first exact filling. Longer lengths come first.
    """
    room = capacity - opener
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == opener), room // length)
        group = 1
        while left > 0:
            take = min(group, left)
            steps.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
            left -= take
            group *= 2
        if sums >> room & 1:
            break
    target = sums.bit_length() - 1
    picked = {opener: 1}
    for before, length, take in reversed(steps):
        if not before >> target & 1:
            picked[length] = picked.get(length, 0) + take
            target -= length * take
    return picked


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Windows for all pieces. Every step uses up at least one length or leaves it short of the pattern."""
    left, out, first = {k: v for k, v in histogram.items() if v > 0}, [], 0
    while left:
        picked = fill(left, max(left), capacity)
        times = min(left[k] // n for k, n in picked.items())
        out.append(Pattern(first, times, tuple(sorted(picked.items(), reverse=True))))
        first += times
        for k, n in picked.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _table(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Slices of the numbered pieces of each length, sorted: key, rank begin, window of the first, offset, per window, length."""
    used: dict[int, int] = {}
    rows = []
    for p in patterns:
        offset = 0
        for length, n in p.lengths:
            begin = used.get(length, 0)
            rows.append((length, begin, p.first, offset, n))
            used[length] = begin + n * p.times
            offset += length * n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces (columns of ``pieces``)."""
    spark = cut.sparkSession
    total = cut.count()
    parts = max(1, -(-total // PART_ROWS))
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts))
    keyed = cut.withColumn("part", spread)
    sizes = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    lengths, begins, firsts, offsets, per_window = _table(plan(histogram, capacity))
    stride = max(total, 1) + 1
    keys = lengths * stride + begins

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(earlier, ["length", "part"])
    numbered = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("earlier")).alias("number"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def step(batch):
        column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate((*names, "number")) if n in ("length", "number")}
        at = np.searchsorted(keys, column["length"] * stride + column["number"], "right") - 1
        nth = column["number"] - begins[at]
        out = {n: batch.column(i) for i, n in enumerate(names)}
        out["sequence_id"] = firsts[at] + nth // per_window[at]
        out["offset"] = offsets[at] + (nth % per_window[at]) * column["length"]
        yield out

    return map_batches(numbered, step, ", ".join(f"`{n}` long" for n in (*names, "sequence_id", "offset")))


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_OF_TEXT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of every document.

    A null or empty text is a document of the end id alone. Documents without id and repeated rows are packed like any
    other, as documents of their own. Other columns are not carried on. The pieces are written once to the shared
    scratch folder, because numbers within a length must not change when a task is run again.
    """
    return place(written(pieces(docs, path, capacity, end_id), "pieces"), capacity)
