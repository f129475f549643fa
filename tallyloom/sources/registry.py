"""Sources by name: where their files land, how they are read, how they become RAW_TXN. A stream lists files and reads them in the same way.

A new source is one more entry. ``parse`` should be built-in expressions; ``mapInPandas`` is the way out for formats
that need a library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import stitch
from tallyloom.sources import cells, csv_sources, lines, openbanking

CSV = "*.{csv,CSV}"
TXT = "*.{txt,TXT}"
JSON = "*.{json,JSON}"


@dataclass(frozen=True)
class Source:
    """``read`` gives rows of the files below a path, or of listed files; ``parse`` turns rows into records."""

    name: str
    folder: str
    glob: str
    read: Callable[[SparkSession, str | list[str], str | None], DataFrame]
    parse: Callable[[DataFrame], DataFrame]

    def records(self, spark: SparkSession, root: str) -> DataFrame:
        return self.parse(self.read(spark, f"{root}/{self.folder}", self.glob))


def csv_source(name: str, parse: Callable[[DataFrame], DataFrame]) -> Source:
    return Source(name, name, CSV, cells.read_cells, parse)


def text_source(name: str, parse: Callable[[DataFrame], DataFrame]) -> Source:
    return Source(name, name, TXT, lines.read_lines, parse)


def openbanking_source(name: str, source_type: str) -> Source:
    return Source(name, name, JSON, openbanking.read_records, lambda rows: openbanking.parse_openbanking(rows, source_type))


#: in registry order, which decides between copies of a record that arrive together
REGISTRY: dict[str, Source] = {
    s.name: s
    for s in (
        csv_source("paypal", csv_sources.parse_paypal),
        csv_source("airbnb", csv_sources.parse_airbnb),
        text_source("ing", stitch.stitch_ing),
        csv_source("ing-csv", csv_sources.parse_ing),
        text_source("hsbc", stitch.stitch_hsbc),
        text_source("coles", stitch.stitch_coles),
        text_source("bankwest", stitch.stitch_bankwest),
        csv_source("bankwest-csv", csv_sources.parse_bankwest),
        csv_source("amex", csv_sources.parse_amex),
    )
}


def register(source: Source, registry: dict[str, Source] = REGISTRY) -> None:
    registry[source.name] = source


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def scan_staging(
    spark: SparkSession, root: str, only: str | None = None, registry: dict[str, Source] = REGISTRY
) -> DataFrame | None:
    """Records of all sources that have files below ``root``; None when there are none.

    A pattern with both cases of the extension lists every file once.
    """
    if only is not None and only not in registry:
        raise ValueError(f"unknown source {only!r}; known: {sorted(registry)}")
    chosen = [registry[only]] if only else list(registry.values())
    frames = []
    for source in chosen:
        try:
            frames.append(source.records(spark, root))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return union_sources(frames) if frames else None
