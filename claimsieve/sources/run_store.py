"""Stored runs behind a commit manifest.

A run's results, its rollup and its quantile sketches are first written to folders of their own, which nobody reads yet.
A commit then adds one small file to the manifest: the full list of runs of a new version. Readers
take the newest version, or one they name, and read the listed folders only. So a call that is repeated or breaks
off half way never shows twice or in part, and dropping or merging runs leaves readers of an earlier version alone.

Two writers that commit at the same time want the same version number; renaming a file to an existing
name fails, and the later one reads the new version and tries again.
"""

from __future__ import annotations

import functools
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.repeats import bits_for, build_filter, ids_of_several_runs
from ..operators.runs import ROLLUP, rollup, run_records

#: What the manifest keeps of a run besides its folders; ``timestamp`` is in microseconds.
RECORD = T.StructType([
    T.StructField("run_id", T.StringType()),
    *[T.StructField(n, T.LongType()) for n in ("claims_count", "high_risk_count", "medium_risk_count", "low_risk_count")],
    T.StructField("avg_risk_score", T.DoubleType()), T.StructField("fraud_predictions", T.LongType()),
    T.StructField("timestamp", T.LongType()), T.StructField("runtime", T.DoubleType()),
])
COMMIT_TRIES = 20
#: Kinds of folders a run has.
FOLDERS = ("data", "rollup", "ids")
#: Bytes of a file that merging aims at.
FILE_BYTES = 256 << 20
#: Parts of a file that merging sorts on their own, since rows in memory take many times the bytes of their file.
FILE_CHUNKS = 16


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class RunStore:
    """Runs below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- manifest --------------------------------------------------------------
    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _system(self):
        return self._at().getFileSystem(self._conf)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of the last change in milliseconds) of what a folder holds."""
        if not self._system().exists(self._at(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._system().listStatus(self._at(folder))]

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(name[:-5]) for name, _ in self._names("manifest") if re.fullmatch(r"\d{12}\.json", name))

    def entries(self, version: int | None = None) -> list[dict]:
        """The runs of a version, by default of the newest; none if nothing has been committed."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return []
        stream = self._system().open(self._at("manifest", f"{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, entries: list[dict]) -> None:
        system, draft = self._system(), self._at("manifest", f".{uuid.uuid4().hex}")
        final = self._at("manifest", f"{version:012d}.json")
        out = system.create(draft, False)
        out.write(json.dumps(entries).encode())
        out.close()
        renames = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(draft, final, renames)
        except Exception as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error) or system.exists(final):
                raise CommitConflict(f"version {version} of {self.path}") from error
            raise

    def update(self, change: Callable[[list[dict]], list[dict]]) -> int:
        """Commit what ``change`` makes of the newest list of runs; returns the version."""
        for _ in range(COMMIT_TRIES):
            newest = max(self.versions(), default=0)
            entries = self.entries(newest)
            changed = change(entries)
            if changed == entries and newest:
                return newest
            try:
                self._commit(newest + 1, changed)
                return newest + 1
            except CommitConflict:
                time.sleep(0.05)
        raise CommitConflict(f"no commit to {self.path} in {COMMIT_TRIES} tries")

    # --- writing ---------------------------------------------------------------
    def _stage(self, df: DataFrame, folder: str) -> str:
        name = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def store(self, scored: DataFrame, run_id: str, runtime: float, timestamp: Column | None = None, on_repeat: str = "replace") -> int:
        """Store one run; returns the version that has it.

        ``on_repeat`` says what happens if there is such a run: "replace" it, "keep" it, or "refuse". Record and
        rollup are computed from what has been written, so the scoring plan runs once. A
        run without claims has a record of zeros.
        """
        if on_repeat not in ("replace", "keep", "refuse"):
            raise ValueError(f"on_repeat is replace, keep or refuse, not {on_repeat}")

        def refuse(entries: list[dict]) -> None:
            if on_repeat == "refuse" and any(e["run_id"] == run_id for e in entries):
                raise ValueError(f"there is a run {run_id} in {self.path}")

        before = self.entries()
        refuse(before)
        if on_repeat == "keep" and any(e["run_id"] == run_id for e in before):
            return max(self.versions())
        results = scored.drop("run_id").withColumn("run_id", F.lit(run_id))
        data = self._stage(results, "data")
        kept = self.spark.read.schema(results.schema).parquet(f"{self.path}/{data}")
        when = F.current_timestamp() if timestamp is None else timestamp
        counts = run_records(kept, []).fillna(0.0, ["avg_risk_score"]).withColumns({"run_id": F.lit(run_id), "timestamp": F.unix_micros(when), "runtime": F.lit(float(runtime))})
        entry = counts.select(*[F.col(f.name).cast(f.dataType) for f in RECORD]).first().asDict()
        entry |= {"data": data, "rollup": self._stage(rollup(kept), "rollup"), "shared": False, "schema": results.schema.json()}
        entry |= {"ids": None, "distinct_ids": 0}
        if "claim_id" in results.columns:
            distinct = kept.agg(F.count_distinct("claim_id")).first()[0]
            entry |= {"ids": self._stage(build_filter(kept, "claim_id", bits_for(distinct)), "ids"), "distinct_ids": distinct}

        def add(entries: list[dict]) -> list[dict]:
            refuse(entries)
            there = any(e["run_id"] == run_id for e in entries)
            return entries if there and on_repeat == "keep" else [e for e in entries if e["run_id"] != run_id] + [entry]

        return self.update(add)

    def retain(self, keep: int) -> int:
        """Drop all but the newest runs, those of one time by descending id; returns the version."""
        newest_first = lambda e: (e["timestamp"], e["run_id"])
        return self.update(lambda entries: sorted(sorted(entries, key=newest_first, reverse=True)[:keep], key=newest_first))

    def compact(self, file_bytes: int = FILE_BYTES) -> int:
        """Merge the runs' files into files of about ``file_bytes``, one folder for all runs of a schema; returns the version.

        A run stored meanwhile stays as it is, and so does one that was replaced or dropped meanwhile.
        """
        before = self.entries()
        moved: dict[str, dict] = {}
        for schema, runs in _by(before, "schema").items():
            folders = {e["data"] for e in runs}
            size = sum(self._system().getContentSummary(self._at(f)).getLength() for f in folders)
            files = max(1, -(-size // file_bytes))
            rows = self._read(runs, "data", T.StructType.fromJson(json.loads(schema)))
            # By run, so that a file has few runs; a large one is spread over many files. Chunks are sorted one by one and then put together.
            chunks = max(1, -(-size * FILE_CHUNKS // file_bytes))
            data = self._stage(rows.repartitionByRange(chunks, "run_id", F.rand(3)).sortWithinPartitions("run_id"), "data")
            if chunks > files:
                parts = data
                data = self._stage(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{parts}").coalesce(files), "data")
                self._system().delete(self._at(parts), True)
            rolled = self._stage(self._read(runs, "rollup", ROLLUP).coalesce(1), "rollup")
            moved |= {e["run_id"]: e | {"data": data, "rollup": rolled, "shared": True} for e in runs}
        old = {e["run_id"]: e for e in before}
        return self.update(lambda entries: [moved[e["run_id"]] if old.get(e["run_id"]) == e else e for e in entries])

    def vacuum(self, keep_versions: int = 1, older_than: float = 86_400.0) -> int:
        """Delete folders that the newest ``keep_versions`` versions don't name, if unchanged for ``older_than`` seconds; returns their number.

        The age protects what a running call has written but not yet committed. Earlier versions can't be read afterwards.
        """
        versions = self.versions()
        kept = versions[-keep_versions:] if keep_versions else []
        used = {e[kind] for v in kept for e in self.entries(v) for kind in FOLDERS}
        limit, gone = time.time() * 1000 - older_than * 1000, 0
        for version in versions[: len(versions) - len(kept)]:
            self._system().delete(self._at("manifest", f"{version:012d}.json"), False)
        for folder in FOLDERS:
            for name, changed in self._names(folder):
                if f"{folder}/{name}" not in used and changed <= limit:
                    self._system().delete(self._at(folder, name), True)
                    gone += 1
        return gone

    # --- reading ---------------------------------------------------------------
    def runs(self, version: int | None = None) -> DataFrame:
        """One record per run."""
        rows = [tuple(e[f.name] for f in RECORD) for e in self.entries(version)]
        return self.spark.createDataFrame(rows, RECORD).withColumn("timestamp", F.timestamp_micros("timestamp"))

    def _read(self, entries: list[dict], kind: str, schema: T.StructType) -> DataFrame:
        """Folders of runs. Merged folders may hold rows of runs that have been dropped or replaced since."""
        reader = self.spark.read.schema(schema)
        own = [f"{self.path}/{e[kind]}" for e in entries if not e["shared"]]
        frames = [reader.parquet(*own)] if own else []
        for folder, runs in _by([e for e in entries if e["shared"]], kind).items():
            frames.append(reader.parquet(f"{self.path}/{folder}").where(F.col("run_id").isin([e["run_id"] for e in runs])))
        return functools.reduce(DataFrame.union, frames)

    def results(self, run_ids: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Results of all runs, or of some; only their folders are read. Columns that a run lacks are null."""
        entries = [e for e in self.entries(version) if run_ids is None or e["run_id"] in run_ids]
        if not entries:
            raise ValueError(f"no such run in {self.path}")
        frames = [self._read(runs, "data", T.StructType.fromJson(json.loads(schema))) for schema, runs in _by(entries, "schema").items()]
        return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)

    def rollup(self, version: int | None = None) -> DataFrame:
        """The runs' rollups: (run_id, kind, item, n, total, sketch). See :func:`claimsieve.operators.runs.rollup`."""
        entries = self.entries(version)
        return self._read(entries, "rollup", ROLLUP) if entries else self.spark.createDataFrame([], ROLLUP)


    def id_filters(self, version: int | None = None) -> dict[str, bytes]:
        """The Bloom filter of each run's claim ids, at most ``MOST_BITS`` each."""
        entries = [e for e in self.entries(version) if e["ids"] is not None]
        folders = {e["ids"].rsplit("/", 1)[1]: e["run_id"] for e in entries}
        if not folders:
            return {}
        read = self.spark.read.schema("filter binary").parquet(*[f"{self.path}/ids/{name}" for name in folders])
        rows = read.select("filter", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder")).collect()
        return {folders[r["folder"]]: bytes(r["filter"]) for r in rows}

    def repeated_ids(self, version: int | None = None) -> DataFrame:
        """(claim_id, runs, n): claim ids in more than one run. Only possible repeats are shuffled."""
        return ids_of_several_runs(self.results(version=version), self.id_filters(version))

    def count_duplicate_ids(self, version: int | None = None) -> DataFrame:
        """One row: occurrences of claim ids beyond the first of each, over all runs.

        The runs' own distinct counts are in the manifest; ids of several runs are counted once for each too often.
        """
        entries = self.entries(version)
        rows, distinct = sum(e["claims_count"] for e in entries), sum(e["distinct_ids"] for e in entries)
        nulls = self.results(version=version).where("claim_id IS NULL").agg((F.count("*") - 1).alias("n"))
        # All rows without id are one id.
        group = nulls.select(F.when(F.col("n") >= 0, 1).otherwise(0).alias("g")).scalar()
        more = self.repeated_ids(version).agg(F.coalesce(F.sum(F.col("runs") - 1), F.lit(0)).alias("more"))
        return more.select((F.lit(rows - distinct) + F.col("more") - group).cast("long").alias("duplicate_ids"))


def _by(entries: list[dict], name: str) -> dict[str, list[dict]]:
    groups: dict[str, list[dict]] = {}
    for entry in entries:
        groups.setdefault(entry[name], []).append(entry)
    return groups
