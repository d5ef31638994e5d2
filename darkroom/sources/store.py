"""A store of assets, decisions and state: Parquet in buckets by id, and a log of decisions, through Spark's own file access."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.sources.schema import ASSETS, META_COLUMNS, REASONS
from darkroom.sources.staging import staged

DECISIONS = "asset_id string, decision string, decided_at bigint"
#: Columns that later schema versions added, with what older rows hold in them.
ADDED = {"byte_size": "cast(0 as bigint)", "is_locally_available": "true", "secondary_backup_label": "cast(null as string)"}
SCHEMA_VERSION = 4
#: Entries of the decision log that are read beside its base; more are folded into a new base.
MOST_ENTRIES = 64
#: Writers that met another's commit try so often.
TRIES = 5


ANALYSIS = ("features", "junk", "miss", "aesthetic", "reasons", "cluster_id", "is_best_in_cluster", "tier_completed", "analyzed_at")


def upserted(stored: DataFrame, incoming: DataFrame, order: str | None = None, analysis: bool = False) -> DataFrame:
    """stored with the metadata of incoming: known ids keep scores, features, tier and cluster; new ones start at tier 0.
    With analysis, the analysis columns that incoming has are taken too. One join does both.

    With an order column the last write of an id wins; without one incoming ids must differ.
    """
    found = [c for c in ANALYSIS if analysis and c in incoming.columns]
    names = [*META_COLUMNS, *found]
    if order:
        last = incoming.groupBy("id").agg(F.max_by(F.struct(*names), F.col(order)).alias("m")).select("m.*")
    else:
        last = incoming.select(*names)
    new = last.select(F.col("id"), F.struct(*names).alias("m"))
    joined = stored.join(new, "id", "full_outer")
    blank = {"junk": "cast(0 as float)", "miss": "cast(0 as float)", "aesthetic": "cast(0.5 as float)", "reasons": f"cast(array() as {_sql(REASONS)})", "is_best_in_cluster": "false", "tier_completed": "0"}
    out = []
    for c in stored.columns:
        if c in names and c != "id":
            out.append(F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c))
        elif c in blank:
            out.append(F.coalesce(F.col(c), F.expr(blank[c])).cast(stored.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def _sql(kind: str) -> str:
    return kind.replace(": ", ":")


def analysed(stored: DataFrame, results: DataFrame) -> DataFrame:
    """stored with the analysis columns of results (features, scores, reasons, cluster, tier) where an id has them."""
    names = [c for c in ("features", "junk", "miss", "aesthetic", "reasons", "cluster_id", "is_best_in_cluster", "tier_completed", "analyzed_at") if c in results.columns]
    new = results.select("id", F.struct(*names).alias("r"))
    joined = stored.join(new, "id", "left")
    return joined.select(*[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


def migrated(df: DataFrame) -> DataFrame:
    """Rows of an older schema version with the columns that came later; where files of several versions were read
    together, these are null in the older rows."""
    missing = df.withColumns({c: F.expr(x) for c, x in ADDED.items() if c not in df.columns})
    return missing.withColumns({c: F.coalesce(F.col(c), F.expr(x)) for c, x in ADDED.items()})


class Store:
    """Assets, decisions, tombstones and state under one folder.

    Assets lie in a fixed number of buckets by a hash of the id. A change reads, merges and writes the buckets of its ids
    alone, as a new version of them; then a commit names the version of every bucket. Readers take the last commit, so
    they see whole snapshots, and a writer that dies leaves the last one in place. Commits are created, never replaced: of
    two writers one meets the other's commit and merges again.

    Decisions are a log: small entries, which cost no Spark job, over a base of Parquet. Beyond MOST_ENTRIES they are folded
    into a new base. State is small JSON text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = int(self.get_state("buckets", {"n": buckets})["n"])
        if self._get("buckets") is None:
            self.put_state("buckets", {"n": buckets})

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str, replace: bool) -> bool:
        """Writes a small file; without replace, False where it is there already."""
        p, fs = self._fs(path)
        if not replace and fs.exists(p):
            return False
        try:
            out = fs.create(p, replace)
        except Exception as e:  # the JVM's FileAlreadyExistsException, which has no class here
            if not replace and "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _drop(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _text(self, path: str) -> str:
        """A small file of the store, whole."""
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, key: str, value: str) -> None:
        self._create(f"{self.path}/kv/{key}.json", json.dumps(value), True)

    def _get(self, key: str) -> str | None:
        p, fs = self._fs(f"{self.path}/kv/{key}.json")
        if not fs.exists(p):
            return None
        try:
            return json.loads(self._text(f"{self.path}/kv/{key}.json"))
        except ValueError:
            return None

    def put_state(self, key: str, value: dict | str) -> None:
        self._put(key, json.dumps(value) if isinstance(value, dict) else value)

    def get_state(self, key: str, default: dict | None = None):
        found = self._get(key)
        if found is None or default is None:
            return default if found is None else found
        try:
            return default | json.loads(found)
        except (ValueError, TypeError):
            return default

    def version(self) -> int:
        names = self._names(f"{self.path}/assets/commits")
        return int(names[-1].split(".")[0]) if names else int(self._get("snapshot") or 0)

    def _commit_of(self, version: int) -> dict[str, str]:
        """The folder of each bucket that has rows. A store of an older version has one folder for all of them."""
        if not version:
            return {}
        p, fs = self._fs(f"{self.path}/assets/commits/{version:012}.json")
        return json.loads(self._text(f"{self.path}/assets/commits/{version:012}.json")) if fs.exists(p) else {"*": f"v{version}"}

    def bucket(self, id: Column | str = "id") -> Column:
        return F.pmod(F.xxhash64(id), F.lit(self.buckets)).cast("int")

    def _read(self, commit: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        schema = T._parse_datatype_string(ASSETS)
        folders = [f for b, f in commit.items() if b == "*" or buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = migrated(self.spark.read.schema(schema).parquet(*[f"{self.path}/assets/{f}" for f in folders])).select(*schema.fieldNames())
        return rows if buckets is None or "*" not in commit else rows.where(self.bucket().isin(buckets))

    def assets(self) -> DataFrame:
        return self._read(self._commit_of(self.version()))

    def assets_of(self, ids: DataFrame) -> DataFrame:
        """The stored assets of ids (id), of which unknown ones are left out; only their buckets are read."""
        some = staged(ids.select("id").where("id is not null").distinct(), "ids")
        return self._read(self._commit_of(self.version()), self._touched(some)).join(some, "id", "left_semi")

    def asset(self, id: str) -> dict | None:
        """One asset, from the one bucket it can be in."""
        at = self.spark.range(1).select(self.bucket(F.lit(id))).first()[0]
        rows = self._read(self._commit_of(self.version()), [at]).where(F.col("id") == id).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # at most one for each bucket

    def _change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merges rows into the buckets of their ids, and into them alone."""
        rows = staged(rows, "incoming")
        touched = self._touched(rows)
        for _ in range(TRIES):
            base = self.version()
            commit = self._commit_of(base)
            some = list(range(self.buckets)) if "*" in commit else touched
            if not some:
                return
            written = self._written(merge(self._read(commit, some), rows))
            if self._committed(base, {b: f for b, f in commit.items() if b != "*" and int(b) not in some} | written):
                return
        raise RuntimeError("other writers committed in between, again and again")

    def _written(self, df: DataFrame) -> dict[str, str]:
        """Writes rows to a new folder; where each bucket that has some lies."""
        folder = f"data-{uuid.uuid4().hex}"
        out = df.select(*T._parse_datatype_string(ASSETS).fieldNames()).withColumn("bucket", self.bucket())
        # ranges, not a task a bucket: what a task sorts does not grow with the store
        parts = max(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        out.repartitionByRange(parts, "bucket", "id").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.path}/assets/{folder}")
        return {x.split("=")[1]: f"{folder}/{x}" for x in self._names(f"{self.path}/assets/{folder}") if x.startswith("bucket=")}

    def _committed(self, base: int, commit: dict[str, str]) -> bool:
        """Makes a commit the one after base; False if another writer was first."""
        done = self._create(f"{self.path}/assets/commits/{base + 1:012}.json", json.dumps(commit), False)
        if done:
            self._put("schema_version", str(SCHEMA_VERSION))
        return done

    def replace(self, df: DataFrame) -> None:
        """df as all assets."""
        written = self._written(df)
        while not self._committed(self.version(), written):
            pass

    def put(self, rows: DataFrame) -> None:
        """Whole rows in place of those of the same id."""
        names = T._parse_datatype_string(ASSETS).fieldNames()
        self._change(rows.select(*names), lambda stored, new: stored.join(new.select("id"), "id", "left_anti").select(*names).unionByName(new))

    def upsert(self, incoming: DataFrame, order: str | None = None) -> None:
        self._change(incoming, lambda stored, new: upserted(stored, new, order))

    def save(self, results: DataFrame) -> None:
        """Metadata and what the analysis found, in one merge."""
        self._change(results, lambda stored, new: upserted(stored, new, analysis=True))

    def _log(self) -> dict:
        return self.get_state("decisions", {"base": "", "folded": "", "old": []})

    def _entries(self, log: dict) -> list[str]:
        return [x for x in self._names(f"{self.path}/decisions/entries") if x > log["folded"] and not x.startswith((".", "_"))]

    def decisions(self) -> DataFrame:
        """The decisions that stand: the base and what was logged since, without keeps that an asset had before a clear."""
        log = self._log()
        return self._standing(log, self._entries(log))

    def _standing(self, log: dict, entries: list[str]) -> DataFrame:
        base = f"{self.path}/decisions/{log['base']}"
        rows = self.spark.read.schema(DECISIONS).parquet(base) if log["base"] else self.spark.createDataFrame([], DECISIONS)
        if entries:
            new = self.spark.read.schema(DECISIONS).json([f"{self.path}/decisions/entries/{x}" for x in entries])
            rows = rows.unionByName(new)
        if not entries:  # a base holds no clears
            return rows
        clears = rows.where("decision = 'clear_keep'").groupBy("asset_id").agg(F.max("decided_at").alias("cleared"))
        left = rows.where("decision <> 'clear_keep'").join(clears, "asset_id", "left")
        return left.where(F.col("cleared").isNull() | (F.col("decision") != "keep") | (F.col("decided_at") >= F.col("cleared"))).drop("cleared")

    def _entry(self) -> str:
        return f"{time.time_ns():020}-{uuid.uuid4().hex[:8]}"

    def log_decision(self, asset: str, decision: str, at: int | None = None) -> None:
        """One decision, as a small file: no Spark job runs, but for a fold once in MOST_ENTRIES."""
        row = json.dumps({"asset_id": asset, "decision": decision, "decided_at": time.time_ns() if at is None else at})
        self._create(f"{self.path}/decisions/entries/{self._entry()}.json", row, True)
        self._fold_if_long()

    def decide(self, decisions: DataFrame) -> None:
        """Many decisions, as one entry of the log."""
        decisions.select("asset_id", "decision", F.col("decided_at").cast("bigint")).write.json(f"{self.path}/decisions/entries/{self._entry()}")
        self._fold_if_long()

    def _fold_if_long(self) -> None:
        if len(self._entries(self._log())) > MOST_ENTRIES:
            self.fold_decisions()

    def fold_decisions(self) -> None:
        """Folds the log's entries into a new base: keeps and clears that cancel each other vanish. Folded entries and the
        base before are deleted one fold later, so a reader that began earlier finds its files."""
        log = self._log()
        entries = self._entries(log)
        if not entries:
            return
        base = f"base-{self._entry()}"
        self._standing(log, entries).repartition("asset_id").write.parquet(f"{self.path}/decisions/{base}")
        gone = [f"entries/{x}" for x in entries] + ([log["base"]] if log["base"] else [])
        self.put_state("decisions", {"base": base, "folded": entries[-1], "old": gone})
        for x in log["old"]:
            self._drop(f"{self.path}/decisions/{x}")

    def delete(self, ids: DataFrame) -> None:
        """Tombstones: nothing is removed, but the queue leaves these ids out."""
        ids.select("id").distinct().write.mode("append").parquet(f"{self.path}/deleted")

    def deleted(self) -> DataFrame:
        p, fs = self._fs(f"{self.path}/deleted")
        return self.spark.read.schema("id string").parquet(f"{self.path}/deleted") if fs.exists(p) else self.spark.createDataFrame([], "id string")
