"""Command line: fuse FILE [--weights TOML], cluster FILE, rank FILE, weights, report GOLD PREDICTED."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from darkroom.operators import evaluation, fusion, ranking, sessions
from darkroom.sources.schema import read_records
from darkroom.sources.weights import Weights


def _flat(df):
    return df.select("id", "created_at", "latitude", "longitude", "burst_id", F.col("features.pixel.dhash").alias("dhash"), F.col("features.embedding.embedding").alias("vector"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="darkroom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("fuse", "cluster", "rank"):
        commands.add_parser(name).add_argument("file")
    commands.choices["fuse"].add_argument("--weights")
    commands.add_parser("weights")
    report = commands.add_parser("report")
    report.add_argument("gold")
    report.add_argument("predicted")
    said = parser.parse_args(args)
    if said.command == "weights":
        sys.stdout.write(Weights().to_toml())
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if said.command == "report":
        read = lambda p: spark.read.schema("file string, labels array<string>, cluster string, is_best boolean").option("multiLine", True).json(p)
        out = evaluation.score_report(read(said.gold), read(said.predicted)).orderBy("category")
    else:
        rows = read_records(spark, said.file)
        if said.command == "fuse":
            weights = Weights.from_toml(Path(said.weights).read_text()) if said.weights else Weights()
            out = fusion.fused(rows, weights).select("id", "junk", "miss", "aesthetic", "reasons", "should_queue")
        else:
            members = sessions.clusters(_flat(rows))
            if said.command == "cluster":
                out = members.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("member_ids"))
            else:
                out = ranking.ranked_clusters(members.join(rows.drop("cluster_id"), "id"))
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
