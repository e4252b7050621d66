"""Allowlist files: one JSON file for each client and assistant, under the name that ``allowlist.refresh`` gives."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.allowlist import normalised_terms, refresh
from spanveil.shared import settled
from spanveil.sources.commits import rename, write

ROW = "client_id string, assistant_id string, source_version string, term_count int, content_hash string, updated_at_epoch double, terms array<string>"


class AllowlistFiles:
    """Lists in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, max_terms: int = 50_000):
        self.spark, self.path, self.max_terms = spark, path, max_terms
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """All lists; a file that is missing, unreadable or without terms gives none."""
        if not self._fs.exists(self._at("")) or not self._fs.globStatus(self._at("*.json")):
            return self.spark.createDataFrame([], ROW)
        raw = self.spark.read.text(f"{self.path}/*.json", wholetext=True).select(F.from_json("value", ROW).alias("r")).select("r.*")
        return raw.where("terms is not null and client_id is not null").withColumn("terms", normalised_terms(F.col("terms")))

    def refresh(self, incoming: DataFrame) -> DataFrame:
        """Take up new lists (see ``allowlist.refresh``); only files whose hash differs are written, each beside its place and then renamed.

        Lists pass the driver one by one, each of at most ``max_terms`` terms.
        """
        done = settled(refresh(self.read(), incoming, self.max_terms))
        for r in done.where("changed").toLocalIterator():
            row = {k: r[k] for k in ("client_id", "assistant_id", "source_version", "term_count", "content_hash", "updated_at_epoch")} | {"terms": list(r["terms"])}
            temporary, place = self._at(f".{r['cache_file']}.tmp"), self._at(r["cache_file"])
            write(self._fs, temporary, json.dumps(row, ensure_ascii=False, separators=(",", ":")))
            rename(self.spark, temporary, place, overwrite=True)
        return done
