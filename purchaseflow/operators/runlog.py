"""The attempt log as published runs, with compacted state.

SNK2/SNK3 as a commit protocol: a run writes its part files to a folder of its own and
then publishes them by one rename of a manifest that names the run.  A second manifest of
the same run is refused, so a run that is submitted again adds nothing, and a run that dies
before the rename leaves only files that no manifest names.  Readers go by the manifests.

SRC6 + REL11 over snapshots: :meth:`RunLog.compact` stores the latest attempt of every file,
bucketed by file name, for all runs up to the last.  :meth:`RunLog.state` then reads that
snapshot and the runs published after it; the snapshot is joined in its buckets, so only
the new runs' rows are shuffled.  What a write has shuffled goes when it ends, and a snapshot
is written a slice of its buckets at a time.  A run's totals and times are taken while its files are
written and kept in its manifest (AGG3, AGG4, FN18): no later scan is needed for them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTEMPTS, RUNS
from ..session import shuffles_freed
from .state import LOG_ORDER, RESULT_STATUSES, SKIP_STATUSES, latest_attempts

COLUMNS = [f.name for f in ATTEMPTS.fields]
STATE = [*COLUMNS, "first_seen", "n_attempts"]
FILES_PER_BUCKET = 1 << 16  # rows of a snapshot's bucket, about; what reads a state has a task for each
LEAST_PER_BUCKET = 1 << 12  # fewer rows are not spread over the shuffle's partitions
SLICES = 8  # parts of a snapshot that are written one after the other, at most
CODEC = "zstd"  # of runs and snapshots: texts and answers take some 40 % less than with Spark's default


@dataclass(frozen=True)
class Run:
    """A manifest: a published run, its folder and what its write counted."""
    run_id: str
    run_seq: int
    folder: str
    n_attempts: int
    n_results: int
    n_skipped: int
    processing_time: float
    wall_time: float


@dataclass(frozen=True)
class Snapshot:
    """The latest attempts of all runs up to ``run_seq``."""
    run_seq: int
    folder: str
    n_files: int
    buckets: int


class RunLog:
    """An attempt log at ``path`` (any file system that Spark can write)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    # ------------------------------------------------------------ files

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _read_json(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _publish_json(self, name: str, content: dict) -> bool:
        """Write a file beside its place and rename it there; False if it is there already."""
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(content).encode("utf-8"))
        stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(
            self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # never over a file that is there
        try:
            context.rename(draft, self._at(name), options)
        except Exception:
            if not self._fs.exists(self._at(name)):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    # ------------------------------------------------------------ runs

    def runs(self) -> list[Run]:
        """The published runs in the log's order: one manifest each, known to the driver."""
        found = [Run(**self._read_json(f"manifests/{n}")) for n in self._names("manifests")]
        return sorted(found, key=lambda r: (r.run_seq, r.run_id))

    @staticmethod
    def _manifest(run_id: str) -> str:
        # Names are written so that any run id is one path segment.
        return f"manifests/{run_id.encode('utf-8').hex()}.json"

    def stage(self, attempts: DataFrame, run_id: str, run_seq: int) -> Run:
        """Write a run's part files to a folder of its own; nobody reads them before
        :meth:`publish_staged`.  The run's totals and times are counted by that write."""
        folder = f"runs/{uuid.uuid4().hex}"
        status, seen = F.col("status"), Observation()
        rows = attempts.withColumns({"run_id": F.lit(run_id), "run_seq": F.lit(run_seq).cast("long")}).select(*COLUMNS)
        counted = rows.observe(
            seen, F.count(F.lit(1)).alias("n_attempts"), F.count_if(status.isin(*RESULT_STATUSES)).alias("n_results"),
            F.count_if(status.isin(*SKIP_STATUSES)).alias("n_skipped"),
            F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("processing_time"),
            F.coalesce(F.sum("wall_time"), F.lit(0.0)).alias("wall_time"))
        with shuffles_freed(self.spark):
            counted.write.option("compression", CODEC).parquet(f"{self.path}/{folder}")
        return Run(run_id=run_id, run_seq=run_seq, folder=folder, **seen.get)

    def publish_staged(self, run: Run) -> bool:
        """Make a staged run part of the log.  False, and its files go, if the run is there."""
        if self._publish_json(self._manifest(run.run_id), asdict(run)):
            return True
        self._fs.delete(self._at(run.folder), True)
        return False

    def publish(self, attempts: DataFrame, run_id: str, run_seq: int) -> bool:
        """Append a run once.  A run that the log has is not evaluated again."""
        if self._fs.exists(self._at(self._manifest(run_id))):
            return False
        return self.publish_staged(self.stage(attempts, run_id, run_seq))

    def attempts(self, after: int | None = None) -> DataFrame:
        """All attempts of the published runs, or of those after a place in the log."""
        folders = [f"{self.path}/{r.folder}" for r in self.runs() if after is None or r.run_seq > after]
        if not folders:
            return self.spark.createDataFrame([], ATTEMPTS).limit(0)  # known to be empty before anything runs
        return self.spark.read.schema(ATTEMPTS).parquet(*folders)

    def run_metrics(self) -> DataFrame:
        """AGG3, AGG4 and FN18 of every run, from the manifests alone."""
        runs = self.spark.createDataFrame([(r.run_id, r.run_seq, r.n_attempts, r.n_results, r.n_skipped, r.processing_time, r.wall_time)
                                           for r in self.runs()], RUNS)
        return runs

    def drop_unpublished(self) -> int:
        """Delete what no manifest names: folders of runs that died before they were
        published, replaced snapshots.  Only while no run is being written."""
        named = {r.folder for r in self.runs()}
        last = self.snapshot()
        named |= {last.folder} if last else set()
        gone = [f"{kind}/{n}" for kind in ("runs", "snapshots", "drafts") for n in self._names(kind) if f"{kind}/{n}" not in named]
        for name in gone:
            self._fs.delete(self._at(name), True)
        return len(gone)

    # ------------------------------------------------------------ state

    def snapshot(self) -> Snapshot | None:
        names = self._names("compacted")
        return Snapshot(**self._read_json(f"compacted/{names[-1]}")) if names else None

    def _snapshot_rows(self, snapshot: Snapshot) -> DataFrame:
        """A snapshot with its buckets, which only a table's description can tell Spark."""
        name = f"runlog_{uuid.uuid4().hex}"
        types = {**{f.name: f.dataType.simpleString() for f in ATTEMPTS.fields}, "first_seen": "bigint", "n_attempts": "bigint"}
        self.spark.sql(f"CREATE TABLE {name} ({', '.join(f'{c} {types[c]}' for c in STATE)}) USING parquet "
                       f"CLUSTERED BY (file_name) SORTED BY (file_name) INTO {snapshot.buckets} BUCKETS "
                       f"LOCATION '{self.path}/{snapshot.folder}'")
        rows = self.spark.table(name)
        rows.schema  # resolved now; the description is not needed any more, the files stay
        self.spark.sql(f"DROP TABLE {name}")
        return rows

    def state(self, payload: list[str] | None = None, among: Column | None = None) -> DataFrame:
        """REL11: the latest attempt of every file (``payload``: the columns to fetch, default
        all), with ``first_seen`` and ``n_attempts``, as the whole log would give it.  Reads
        the last snapshot and the runs after it.  ``among``: a condition on ``file_name``; other
        files are left out before anything is shuffled."""
        columns = [c for c in (payload or COLUMNS) if c not in ("file_name", *LOG_ORDER)]
        wanted = ["file_name", *columns, *LOG_ORDER, "first_seen", "n_attempts"]
        last, some = self.snapshot(), F.lit(True) if among is None else among
        if last is None:
            return latest_attempts(self.attempts().filter(some), payload=columns).select(wanted)
        old = self._snapshot_rows(last).select(wanted).filter(some)
        if not any(r.run_seq > last.run_seq for r in self.runs()):
            return old
        new = latest_attempts(self.attempts(after=last.run_seq).filter(some), payload=columns).select(wanted)
        # A later run wins; the first run and the counts go on from the snapshot.
        is_new = F.col("n.file_name").isNotNull()
        newest = {c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in (*columns, *LOG_ORDER)}
        return old.alias("o").join(new.alias("n"), F.col("o.file_name") == F.col("n.file_name"), "full").select(
            F.coalesce("n.file_name", "o.file_name").alias("file_name"), *[v.alias(c) for c, v in newest.items()],
            F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
            (F.coalesce("o.n_attempts", F.lit(0)) + F.coalesce("n.n_attempts", F.lit(0))).alias("n_attempts"))

    def compact(self, files_per_bucket: int = FILES_PER_BUCKET) -> Snapshot | None:
        """Store the state of all published runs as a new snapshot; None for an empty log.
        Runs must be published in the order of their ``run_seq``: one that is published
        later with a place before the snapshot's is refused by :meth:`publish_staged`'s
        caller, as :meth:`state` would not see it."""
        runs, last = self.runs(), self.snapshot()
        if not runs or (last and last.run_seq >= runs[-1].run_seq):
            return last
        n_new = sum(r.n_attempts for r in runs if not last or r.run_seq > last.run_seq)
        bound = n_new + (last.n_files if last else 0)  # of the number of files
        wide = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, -(-bound // files_per_bucket), min(wide, bound // LEAST_PER_BUCKET))
        folder, name, n_files = f"snapshots/{uuid.uuid4().hex}", f"runlog_{uuid.uuid4().hex}", 0
        # Some buckets after the others, each time all their files: of the shuffled texts only a
        # slice is on disk at once, for a bounded number of reads.
        slices = max(1, min(SLICES, bound // files_per_bucket))
        bucket = F.pmod(F.hash("file_name"), F.lit(buckets))
        with shuffles_freed(self.spark):
            for i in range(slices):
                seen, among = Observation(), bucket.between(buckets * i // slices, buckets * (i + 1) // slices - 1)
                (self.state(among=among).select(STATE).repartition(buckets, "file_name").observe(seen, F.count(F.lit(1)).alias("n"))
                 .write.mode("append").bucketBy(buckets, "file_name").sortBy("file_name").format("parquet")
                 .option("compression", CODEC).option("path", f"{self.path}/{folder}").saveAsTable(name))
                n_files += seen.get["n"]
        self.spark.sql(f"DROP TABLE {name}")
        snapshot = Snapshot(runs[-1].run_seq, folder, n_files, buckets)
        if not self._publish_json(f"compacted/{runs[-1].run_seq:020d}.json", asdict(snapshot)):
            self._fs.delete(self._at(folder), True)
        return self.snapshot()
