"""Near-duplicates of a text file from the command line: python -m kindred.plans.near_duplicates TEXT OUT --low 0.5 --high 1.0 --steps 30

OUT gets clusters and their sizes and edges for every threshold, and with --labels the area under the curve of pair agreement.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kindred.operators import lsh
from kindred.runtime import Scratch
from kindred.sources import annotated


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("text", help="a document in each line")
    out.add_argument("out", help="folder for the results")
    out.add_argument("--threshold", type=float, help="one threshold, in place of a sweep")
    out.add_argument("--low", type=float, default=0.5)
    out.add_argument("--high", type=float, default=1.0)
    out.add_argument("--steps", type=int, default=30)
    out.add_argument("--lines", type=int, help="read so many lines only")
    out.add_argument("--labels", help="file of a cluster number in each line, in the order of the documents: also write match_auc")
    out.add_argument("--no-clusters", action="store_true", help="leave the clusters out")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("near duplicates").getOrCreate()
    docs = annotated.read_corpus(spark, asked.text)
    if asked.lines is not None:
        docs = docs.where(docs["doc_id"] < asked.lines)
    scratch = Scratch(spark, "near-duplicates")
    sigs = scratch.keep(lsh.signatures(docs))
    if not asked.no_clusters:
        ts = [asked.threshold] if asked.threshold is not None else lsh.thresholds(asked.low, asked.high, asked.steps)
        swept = scratch.keep(lsh.sweep(docs, ts))
        lsh.write_clusters(swept, f"{asked.out}/clusters")
        for t in ts:
            found = swept.where(swept["threshold"] == float(t)).select("record_id", "cluster_id")
            lsh.write_summary(lsh.cluster_summary(found, sigs, t), f"{asked.out}/summary/threshold={t}")
    if asked.labels:
        labels = annotated.read_labels(spark, asked.labels)
        lsh.match_auc(labels, sigs).coalesce(1).write.mode("overwrite").csv(f"{asked.out}/match_auc", header=True)


if __name__ == "__main__":
    main()
