"""The transaction store: Parquet, partitioned by financial year, with commits.

Layout below the root::

    v<N>/commits/<k>.json  what commit k added: a folder of files in some of the tables
    v<N>/transactions/in=<folder>/fy=<Y>/
    v<N>/raw_audit/in=<folder>/fy=<Y>/  dedup_hash, source_file, raw
    v<N>/fx/in=<folder>/      rates, in generations
    v<N>/splits/in=<folder>/fy=<Y>/  shares; a commit may replace those of a year
    v<N>/quarantine/in=<folder>/  records that could not be read

A writer reads the commits there are, writes its files where nobody looks, and then creates the next numbered commit, which
only one writer can: the others look at what was added meanwhile, leave out what is known now, and try the number
after it. Readers list commits, so all tables of a batch appear at once, and what a crashed writer left is never read. The last
commit of a version seals it and names the folder that the next version begins with; readers and writers go on there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.config import Settings
from tallyloom.functions import scalars as S
from tallyloom.operators import fx as FX
from tallyloom.operators.accounts import latest_balance
from tallyloom.operators.normalize import Normalized, accepted, among, normalize, with_identity
from tallyloom.operators.splits import compute_splits
from tallyloom.plans.summaries import coverage
from tallyloom.schema import FX_RATES, RAW_TXN, REJECT, SPLITS, TXN
from tallyloom.session import created, removed, scratch_path

AUDIT = T.StructType(
    [
        T.StructField("dedup_hash", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
        T.StructField("batch_id", T.LongType()),
        T.StructField("fy", T.IntegerType()),
    ]
)
FX_TABLE = T.StructType([*FX_RATES.fields, T.StructField("seq", T.LongType())])
QUARANTINE = T.StructType([*RAW_TXN.fields, T.StructField(REJECT, T.StringType()), T.StructField("batch_id", T.LongType())])
#: identities are 64 hexadecimal digits, of which only a codec that codes single characters saves half
PACKED = {"compression": "zstd"}
#: a commit's folder in a table is a partition of it, whose name is not read
FOLDER = "in"
COMMIT = "seq long, folder string, tables array<string>, replaced int, sealed boolean"


@dataclass(frozen=True)
class Outcome:
    inserted: int
    skipped: int
    years: tuple[int, ...]


class Sealed(RuntimeError):
    """The version was replaced by the next one."""


class Store:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.version = self._current_version() if version is None else version

    # --- reading ---------------------------------------------------------------------------------------------------

    def _log(self, version: int) -> list[Row]:
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.root}/v{version}/commits").collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    def commits(self) -> list[Row]:
        """Commits of the version in order, that which sealed the version before it first; compaction keeps them few."""
        begun = [Row(**{**c.asDict(), "seq": 0, "sealed": False}) for c in self._log(self.version - 1) if c["sealed"]] if self.version else []
        return begun + sorted(self._log(self.version), key=lambda c: c["seq"])

    def _folders(self, name: str, commits: list[Row]) -> list[str]:
        return [self._folder(name, c["folder"]) for c in commits if name in c["tables"] and not c["sealed"]]

    def _read(self, name: str, schema: T.StructType, commits: list[Row] | None = None) -> DataFrame:
        folders = self._folders(name, self.commits() if commits is None else commits)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*folders).select(*schema.names)

    def _folder(self, name: str, folder: str) -> str:
        return f"{self.path(name)}/{FOLDER}={folder}"

    def path(self, name: str) -> str:
        return f"{self.root}/v{self.version}/{name}"

    def transactions(self) -> DataFrame:
        return self._read("transactions", TXN)

    def raw_audit(self) -> DataFrame:
        return self._read("raw_audit", AUDIT)

    def quarantined(self) -> DataFrame:
        return self._read("quarantine", QUARANTINE)

    def fx_rates(self, commits: list[Row] | None = None) -> DataFrame:
        """First rate per day and pair over all batches."""
        return self._read("fx", FX_TABLE, commits).groupBy(*FX.KEY).agg(F.min_by("rate", "seq").alias("rate"))

    def splits(self) -> DataFrame:
        """Shares, of a replaced year only those added by its last replacement and after it."""
        commits = self.commits()
        replaced = {c["replaced"]: c["seq"] for c in commits if c["replaced"] is not None}
        groups: dict[tuple[int, ...], list[Row]] = {}
        for c in commits:
            groups.setdefault(tuple(sorted(y for y, seq in replaced.items() if seq > c["seq"])), []).append(c)
        parts = [self._read("splits", SPLITS, cs).where(~F.col("fy").isin(*gone)) for gone, cs in groups.items()]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self._read("splits", SPLITS, [])

    def with_raw(self) -> DataFrame:
        """Transactions with the raw record of each; both sides are unique in the identity."""
        return self.transactions().join(self.raw_audit().select("dedup_hash", "raw"), "dedup_hash", "left")

    def balances(self, accounts: DataFrame) -> DataFrame:
        """Visible accounts with transaction count and balance."""
        return latest_balance(self.transactions(), accounts, self.raw_audit())

    # --- writing ---------------------------------------------------------------------------------------------------

    def known_hashes(self, years: tuple[int, ...], by_reference: bool, commits: list[Row] | None = None) -> DataFrame:
        """Identities a batch can collide with.

        Content identities contain the date, so only the years of the batch are read. Reference identities do not;
        when the batch has any, the reference-keyed rows of the other years are read too.
        """
        stored = self._read("transactions", TXN, commits)
        hashes = stored.where(F.col("fy").isin(*years)).select("dedup_hash")
        if by_reference:
            others = stored.where(~F.col("fy").isin(*years) & S.keyed_by_reference())
            hashes = hashes.union(others.select("dedup_hash"))
        return hashes

    def ingest(
        self, records: DataFrame, settings: Settings, learned: DataFrame | None = None, *, batch_id: int = 0, hooks=(), splits: bool = False
    ) -> Outcome:
        """Add the unseen transactions of a batch, its audit rows, FX rates and rejected records, in one commit.

        The parsed batch and the new rows are each written once to the shared scratch folder and read back from there:
        parsing happens once, and a lost executor costs a re-read. Both copies are removed when all is committed; after a failure they stay.
        When other writers commit meanwhile, only what they added is compared with the new rows; if any is known now, the
        batch is matched again. With ``splits`` the shares of the new rows are added to the splits table as well.
        """
        parsed = scratch_path(self.spark, "parsed")
        with_identity(records).write.options(**PACKED).parquet(parsed)
        batch = self.spark.read.schema(with_identity(records).schema).parquet(parsed)
        outcome, store = None, self
        while outcome is None:
            try:
                outcome = store._add(batch, settings, learned, batch_id, hooks, splits)
            except Sealed:
                store = Store(self.spark, self.root)
                self.version = store.version
        removed(self.spark, parsed)
        return outcome

    def _add(self, batch: DataFrame, settings: Settings, learned: DataFrame | None, batch_id: int, hooks, splits: bool) -> Outcome | None:
        """One attempt; None if another writer's commit holds some of the same rows."""
        commits = self.commits()
        if any(c["sealed"] for c in commits):
            raise Sealed(self.root)
        identified = accepted(batch)
        facts = identified.agg(
            F.count(F.lit(1)).alias("n"),
            F.collect_set(S.fy_of("txn_date")).alias("years"),
            F.coalesce(F.bool_or(S.keyed_by_reference()), F.lit(False)).alias("by_reference"),
        ).first()
        years = tuple(sorted(facts["years"]))
        folder, tables, staging = uuid.uuid4().hex, [], scratch_path(self.spark, "ingest")

        def write(rows: DataFrame, name: str, *by: str) -> None:
            rows.write.options(**PACKED).partitionBy(*by).parquet(self._folder(name, folder))
            tables.append(name)

        rejected = self._rejected(batch, batch_id, commits)
        if rejected is not None:
            write(rejected, "quarantine")
        added: dict[int, int] = {}
        staged = None
        if years:
            known = among(self.known_hashes(years, facts["by_reference"], commits), identified, facts["n"])
            staged = self._stage(normalize(batch, settings, known, learned, batch_id=batch_id, hooks=hooks), staging)
            added = {r["fy"]: r["n"] for r in staged.groupBy("fy").agg(F.count(F.lit(1)).alias("n")).collect()}
            fresh = FX.extract_fx(identified).join(self.fx_rates(commits).select(*FX.KEY), FX.KEY, "left_anti")
            write(fresh.select(*FX.KEY, "rate", F.lit(batch_id).cast("long").alias("seq")), "fx")
        if added:
            write(staged.select(*AUDIT.names), "raw_audit", "fy")
            write(staged.drop("raw"), "transactions", "fy")
            if splits:
                write(compute_splits(staged, settings.tax).select(*SPLITS.names), "splits", "fy")

        def clashes(others: list[Row]) -> bool:
            if rejected is not None and self._folders("quarantine", others):
                return True
            new = self._read("transactions", TXN, others).select("dedup_hash")
            return bool(added) and not staged.join(new, "dedup_hash", "left_semi").isEmpty()

        done = not tables or self._commit(commits, folder, tables, clashes)
        removed(self.spark, staging, *([] if done else [self._folder(name, folder) for name in tables]))
        if not done:
            return None
        inserted = sum(added.values())
        return Outcome(inserted, facts["n"] - inserted, tuple(sorted(added)))

    def _commit(
        self, seen: list[Row], folder: str, tables: list[str], clashes: Callable[[list[Row]], bool], replaced: int | None = None, sealed: bool = False
    ) -> bool:
        """Create the next commit after those seen; False if what others committed meanwhile clashes."""
        while True:
            number = max((c["seq"] for c in seen), default=0) + 1
            entry = {"seq": number, "folder": folder, "tables": tables, "replaced": replaced, "sealed": sealed}
            if created(self.spark, f"{self.path('commits')}/{number:012d}.json", json.dumps(entry)):
                return True
            now = self.commits()
            others = [c for c in now if c["seq"] >= number]
            if any(c["sealed"] for c in others):
                raise Sealed(self.root)
            if clashes(others):
                return False
            seen = now

    def _stage(self, result: Normalized, path: str) -> DataFrame:
        """The new rows, written once. They are dealt by identity already, so a year that is most of a batch is spread over all tasks."""
        result.new.write.options(**PACKED).parquet(path)
        return self.spark.read.schema(result.new.schema).parquet(path)

    def _rejected(self, records: DataFrame, batch_id: int, commits: list[Row]) -> DataFrame | None:
        """Rejected records that are not in quarantine yet; None if the batch has none."""
        if REJECT not in records.columns:
            return None
        content = F.sha2(F.concat_ws("\x1f", "source_file", "date_raw", "description", REJECT, F.to_json("raw")), 256)
        bad = records.where(F.col(REJECT).isNotNull()).withColumns({"batch_id": F.lit(batch_id).cast("long"), "_content": content})
        n = bad.count()
        if n == 0:
            return None
        known = among(self._read("quarantine", QUARANTINE, commits).select(content.alias("_content")), bad, n, "_content")
        return bad.join(known, "_content", "left_anti").select(*QUARANTINE.names)

    def compact(self, rows_per_file: int = 5_000_000) -> "Store":
        """A next version with the same rows, each year in as few files as its number of rows asks for.

        Many small batches leave many small files and commits. Readers are switched when all is written. A commit that comes
        while it is written makes it begin again; when it is complete the old version is sealed, so no later commit is lost.
        """
        while True:
            seen, fresh = self.commits(), self._next()
            rows = self._read("transactions", TXN, seen)
            counts = rows.groupBy("fy").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per year
            files = F.lit(1)
            for row in counts:
                files = F.when(F.col("fy") == row["fy"], F.lit(-(-row["n"] // rows_per_file))).otherwise(files)
            total, folder = sum(-(-row["n"] // rows_per_file) for row in counts), uuid.uuid4().hex
            for name, table in (("transactions", rows), ("raw_audit", self._read("raw_audit", AUDIT, seen))):
                spread = table.repartition(max(1, total), "fy", F.pmod(F.xxhash64("dedup_hash"), files))
                spread.write.options(**PACKED).partitionBy("fy").parquet(fresh._folder(name, folder))
            for name, table, by in (("fx", self._read("fx", FX_TABLE, seen), []), ("splits", self.splits(), ["fy"]), ("quarantine", self._read("quarantine", QUARANTINE, seen), [])):
                table.write.partitionBy(*by).parquet(fresh._folder(name, folder))
            tables = ["transactions", "raw_audit", "fx", "splits", "quarantine"]
            if self._commit(seen, folder, tables, clashes=lambda others: True, sealed=True):
                return fresh

    def _next(self) -> "Store":
        """The version after this one, without what a replay that failed has left in it."""
        removed(self.spark, f"{self.root}/v{self.version + 1}/commits")
        return Store(self.spark, self.root, self.version + 1)

    def backfill_splits(self, settings: Settings, fy: int | None = None) -> int:
        """Recompute the splits of one year and replace that year's, also when none are left."""
        year = settings.tax.financial_year if fy is None else fy
        while True:
            seen, folder = self.commits(), uuid.uuid4().hex
            rows = compute_splits(self._read("transactions", TXN, seen), settings.tax, year).select(*SPLITS.names)
            rows.write.partitionBy("fy").parquet(self._folder("splits", folder))
            if self._commit(seen, folder, ["splits"], clashes=lambda others: True, replaced=year):
                return self.spark.read.schema(SPLITS).parquet(self._folder("splits", folder)).count()

    # --- versions --------------------------------------------------------------------------------------------------

    def _current_version(self) -> int:
        """The first version that isn't sealed."""
        version = 0
        while any(c["sealed"] for c in self._log(version)):
            version += 1
        return version

    def rebuild(
        self, records: DataFrame, settings: Settings, learned: DataFrame | None = None, *, years=(), hooks=()
    ) -> tuple["Store", DataFrame]:
        """Replay archived records into the next version, recompute splits, then switch readers to it.

        Returns the new store and its coverage. The current version stays readable until the switch. What is committed to
        it meanwhile is replaced as well, as everything in it is. One replay at a time.
        """
        fresh = self._next()
        outcome = fresh.ingest(records, settings, learned, hooks=hooks)
        for year in years or outcome.years:
            fresh.backfill_splits(settings, year)
        self._commit(self.commits(), "", [], clashes=lambda others: False, sealed=True)
        return fresh, coverage(fresh.transactions())


def tag_bridge(txns: DataFrame) -> DataFrame:
    """(txn_id, tag), each pair once."""
    return txns.select("txn_id", F.explode(F.array_distinct("tags")).alias("tag"))


def add_tags(txns: DataFrame, tags: DataFrame) -> DataFrame:
    """Add tags of a (txn_id, tag) frame to the rows, ignoring those already present."""
    grouped = tags.groupBy("txn_id").agg(F.array_sort(F.collect_set("tag")).alias("_more"))
    empty = F.array().cast("array<string>")
    joined = txns.join(grouped, "txn_id", "left")
    return joined.withColumn("tags", F.array_union("tags", F.coalesce("_more", empty))).drop("_more")


def replace_splits_of_fy(splits: DataFrame, recomputed: DataFrame, fy: int) -> DataFrame:
    """The splits table with one year's rows replaced, as a frame; the store does it by overwriting the folder."""
    return splits.where(F.col("fy") != fy).unionByName(recomputed)
