"""Running values along very long sequences: totals, carried-forward and upcoming values, states of a machine.

A window over a whole sequence runs in one task. Here a sequence is cut into chunks: each chunk is accumulated on its
own, the chunk totals are accumulated per sequence, and what came before a chunk is added to it. A sequence of a
billion rows becomes 50 000 chunk rows, and the long frame is shuffled once, whatever is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 20_000


def chunk() -> Column:
    return F.expr(f"seq div {CHUNK_ROWS}")


@dataclass(frozen=True)
class Machine:
    """A machine with few states, numbered from 0. ``moves[e][s]`` is the state after event e in state s.

    A sequence of events maps each state to the state it ends in. A machine has few such maps, so they are numbered, number 0
    changes nothing, and composing two is a look-up: sequences are folded apart and in parallel.
    """

    moves: tuple[tuple[int, ...], ...]
    start: int = 0

    def maps(self) -> list[tuple[int, ...]]:
        """All maps that events compose to."""
        found = [tuple(range(len(self.moves[0])))]
        for known in found:
            found += [m for m in dict.fromkeys(tuple(e[s] for s in known) for e in self.moves) if m not in found]
        return found

    def numbers(self, events: Column) -> Column:
        """Numbers of the maps of single events."""
        every = self.maps()
        return F.transform(events, lambda e: _at([every.index(m) for m in self.moves], e["event"]))

    def doubled(self, runs: Column, k: int) -> Column:
        """Maps of the last 2k events at each event, from those of the last k."""
        every = self.maps()
        table = [every.index(tuple(b[s] for s in a)) for a in every for b in every]
        longer = F.transform(runs, lambda m, i: F.when(i >= k, _at(table, F.get(runs, i - k) * len(every) + m)).otherwise(m))
        return F.when(F.size(runs) > k, longer).otherwise(runs)

    def after(self, number: Column, state: Column) -> Column:
        """State after the events of a map, from a state."""
        return _at([s for m in self.maps() for s in m], number * len(self.moves[0]) + state)

    def entering(self, numbers: Column) -> Column:
        """State after a sequence of maps."""
        return F.aggregate(numbers, F.lit(self.start), lambda s, m: self.after(m, s))


def _at(table: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in table]), index)


def accumulate(
    rows: DataFrame,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    *,
    earlier: Mapping[str, Column] | None = None,
    marks: Mapping[str, tuple[str, Column]] | None = None,
    nexts: Mapping[str, Column] | None = None,
    states: Mapping[str, tuple[Machine, Column]] | None = None,
) -> DataFrame:
    """Add running values per ``file`` in order of (``block``, ``seq``).

    ``sums``: totals, and ``lasts``: last non-NULL values, both with this row. ``earlier``: last non-NULL values before this row.
    ``marks``: the total of a sum at the last row, up to this one, that meets a condition. ``nexts``: next non-NULL values after this
    row. ``states``: the state of a machine after this row, from a column of its events.
    """
    sums, lasts, earlier, marks, nexts, states = (dict(x or {}) for x in (sums, lasts, earlier, marks, nexts, states))
    plain = {**sums, **lasts, **earlier, **nexts, **{n: e for n, (_, e) in states.items()}, **{n: c for n, (_, c) in marks.items()}}
    keyed = rows.withColumns({"_chunk": chunk(), **{f"_in_{n}": c for n, c in plain.items()}})
    key = ["file", "block", "_chunk"]
    order = Window.partitionBy(*key).orderBy("seq")
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumns(
        {
            **{n: F.sum(f"_in_{n}").over(upto) for n in sums},
            **{n: F.last(f"_in_{n}", ignorenulls=True).over(upto) for n in lasts},
            **{n: F.last(f"_in_{n}", ignorenulls=True).over(past) for n in earlier},
            **{n: F.count(f"_in_{n}").over(upto) for n in states},
        }
    )
    local = local.withColumns({n: F.last(F.when(F.col(f"_in_{n}"), F.coalesce(F.col(s), F.lit(0))), ignorenulls=True).over(upto) for n, (s, _) in marks.items()})
    if nexts:
        later = Window.partitionBy(*key).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumns({n: F.last(f"_in_{n}", ignorenulls=True).over(later) for n in nexts})

    def ends(name: str, pick) -> Column:
        return pick(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), F.col("seq")))

    # marks hold a total inside their chunk: the chunk's last one is its total less what came after the row
    inputs = keyed if not marks else local
    totals = inputs.groupBy(*key).agg(
        *[F.sum(f"_in_{n}").alias(n) for n in sums],
        *[ends(n, F.max_by).alias(n) for n in (*lasts, *earlier)],
        *[F.max_by(n, "seq").alias(n) for n in marks],
        *[ends(n, F.min_by).alias(n) for n in nexts],
        *[F.array_sort(F.collect_list(F.when(F.col(f"_in_{n}").isNotNull(), F.struct("seq", F.col(f"_in_{n}").alias("event"))))).alias(n) for n in states],
    )
    # a byte per event: the map of all events of the chunk up to it
    for n, (m, _) in states.items():
        totals = totals.withColumn(n, m.numbers(F.col(n)))
        for k in (1 << i for i in range(CHUNK_ROWS.bit_length())):
            totals = totals.withColumn(n, m.doubled(F.col(n), k))
        totals = totals.withColumn(n, F.col(n).cast("array<tinyint>"))
    maps = {n: F.coalesce(F.get(n, F.size(n) - 1), F.lit(0)).cast("int") for n in states}
    before = Window.partitionBy("file").orderBy("block", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("file").orderBy(F.desc("block"), F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"_before_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums})
    offsets = offsets.withColumns({n: F.col(n) + F.col(f"_before_{s}") for n, (s, _) in marks.items()})
    offsets = offsets.withColumns(
        {
            **{f"_before_{n}": F.last(n, ignorenulls=True).over(before) for n in (*lasts, *earlier, *marks)},
            **{f"_before_{n}": F.last(n, ignorenulls=True).over(back) for n in nexts},
            **{f"_before_{n}": m.entering(F.collect_list(maps[n]).over(before)) for n, (m, _) in states.items()},
        }
    )
    runs = {f"_runs_{n}": F.col(n) for n in states}
    offsets = offsets.withColumns(runs).select(*key, *[f"_before_{n}" for n in plain], *runs)
    joined = local.join(offsets, key)

    def state(name: str, machine: Machine) -> Column:
        """The map up to the row's last event, from the state that the chunk begins in."""
        run = F.coalesce(F.get(f"_runs_{name}", (F.col(name) - 1).cast("int")).cast("int"), F.lit(0))
        return machine.after(run, F.col(f"_before_{name}"))

    whole = joined.withColumns(
        {
            **{n: F.coalesce(F.col(n) + F.col(f"_before_{s}"), F.col(f"_before_{n}")) for n, (s, _) in marks.items()},
            **{n: F.coalesce(F.col(n), F.col(f"_before_{n}")) for n in (*lasts, *earlier, *nexts)},
            **{n: state(n, m) for n, (m, _) in states.items()},
        }
    ).withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_before_{n}") for n in sums})
    return whole.drop("_chunk", *[f"_in_{n}" for n in plain], *[f"_before_{n}" for n in plain], *runs)


def filled(column: str) -> Column:
    """The text of a column, null where it is blank."""
    return F.when(F.col(column) != "", F.col(column))


def with_next(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the next value of a text column that isn't blank, in the order of the file, over chunks and blocks."""
    return accumulate(rows, nexts={name: filled(column)})
