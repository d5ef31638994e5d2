"""Tables dealt to buckets by id and sorted in each, so that joins by id shuffle neither side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from darkroom.operators.queue import kept_ids


class Bucketed:
    """Bucketed tables of one folder. All have as many buckets, so rows of one id lie in files of one number.

    write() replaces a table, attach() registers one that another session has written: the files name their buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, prefix: str | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.prefix = prefix or f"b{uuid.uuid4().hex[:12]}"

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def write(self, df: DataFrame, table: str, key: str = "id") -> DataFrame:
        """df as a table, a file a bucket; rows are shuffled here once, and not again."""
        out = df.repartition(self.buckets, key).write.mode("overwrite").format("parquet")
        out.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{table}-{uuid.uuid4().hex}").saveAsTable(self.name(table))
        return self.table(table)

    def attach(self, table: str, schema: str, path: str, key: str = "id") -> DataFrame:
        self.spark.sql(f"create table if not exists {self.name(table)} ({schema}) using parquet options (path '{path}') clustered by ({key}) sorted by ({key}) into {self.buckets} buckets")
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def folder(self, table: str) -> str:
        rows = self.spark.sql(f"describe formatted {self.name(table)}").where("col_name = 'Location'").select("data_type").collect()
        return rows[0][0]

    def lookup(self, assets: str = "assets", ids: str = "ids") -> DataFrame:
        """The assets whose id the other table has."""
        return self.table(assets).join(self.table(ids).select("id").hint("merge"), "id", "left_semi")

    def not_kept(self, assets: str = "assets", decisions: str = "decisions") -> DataFrame:
        """The assets that no decision keeps; decisions are bucketed by asset_id."""
        return self.table(assets).join(kept_ids(self.table(decisions)).hint("merge"), "id", "left_anti")

    def members(self, members: str = "members", assets: str = "assets") -> DataFrame:
        """Members of clusters with their assets' columns."""
        rows = self.table(assets)
        return self.table(members).join(rows.drop(*[c for c in self.table(members).columns if c != "id"]).hint("merge"), "id")

    def drop(self) -> None:
        """Forgets the tables; files stay."""
        for r in self.spark.sql(f"show tables like '{self.prefix}_*'").collect():
            self.spark.sql(f"drop table if exists {r.tableName}")
