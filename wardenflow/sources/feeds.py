"""Exploit feeds, lockfiles, owners, apply files and stored runs."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenflow.functions import scalar as X
from wardenflow.operators.findings import FINDING
from wardenflow.sources.ignore import owner_rules


def epss_csv(spark: SparkSession, path: str) -> DataFrame:  # S12
    """cve, epss, percentile; comment and header lines are skipped."""
    rows = spark.read.csv(path, comment="#").toDF("cve", "epss", "percentile")
    return rows.select(F.upper(F.trim("cve")).alias("cve"), F.col("epss").try_cast("double").alias("epss"), F.col("percentile").try_cast("double").alias("percentile")).filter(F.col("cve").startswith("CVE-"))


def kev_json(spark: SparkSession, path: str) -> DataFrame:  # S13: a malformed file has no rows
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", "vulnerabilities array<struct<cveID string, dateAdded string>>").alias("j"))
    return j.select(F.explode("j.vulnerabilities").alias("v")).select(F.upper("v.cveID").alias("cve"), "v.dateAdded")


def npm_lock(df: DataFrame) -> DataFrame:  # S24
    """name, is_dev of each entry of package-lock texts (``content``); devOptional counts as runtime."""
    j = df.select(F.from_json("content", "packages map<string, struct<dev boolean, devOptional boolean>>, dependencies map<string, struct<dev boolean>>").alias("j"))
    new = j.select(F.explode("j.packages").alias("k", "v")).filter("k <> ''").select(X.package_of_lock_key(F.col("k")).alias("name"), (F.coalesce("v.dev", F.lit(False)) & ~F.coalesce("v.devOptional", F.lit(False))).alias("is_dev"))
    old = j.filter("j.packages is null").select(F.explode("j.dependencies").alias("k", "v")).select(F.col("k").alias("name"), F.coalesce("v.dev", F.lit(False)).alias("is_dev"))
    return new.unionByName(old)


def codeowners(spark: SparkSession, text: str) -> DataFrame:  # S23
    """ord, pattern, prefix, owners of the rules of a CODEOWNERS text; the last that matches a path wins."""
    return owner_rules(spark.createDataFrame([*enumerate(text.splitlines())], "ord int, text string"))


def apply_files(spark: SparkSession, where: str, pattern: str = r".*\.json$") -> DataFrame:  # S26
    """Rows of one file, a comma list or a folder's matching files, in order, with ``pos``. A folder without any fails."""
    if Path(where).is_dir():
        files = sorted(str(f) for f in Path(where).iterdir() if re.match(pattern, f.name))
        if not files:
            raise FileNotFoundError(f"no file in {where} matches {pattern}")
    else:
        files = [x for x in where.split(",") if x]
    row = "struct<id string, verdict string, note string, exploitPath string, brocard string>"
    parts = []
    for n, f in enumerate(files):
        j = spark.read.text(f, wholetext=True)
        rows = F.coalesce(F.from_json("value", f"verdicts array<{row}>")["verdicts"], F.from_json("value", f"array<{row}>"))
        parts.append(j.select(F.posexplode(rows).alias("p", "r")).select((F.lit(n).cast("long") * 1_000_000_000 + F.col("p")).alias("pos"), "r.id", "r.verdict", "r.note", F.col("r.exploitPath").alias("exploit_path"), "r.brocard"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_run(findings: DataFrame, folder: str) -> None:  # K1
    findings.write.mode("overwrite").parquet(f"{folder}/findings")


def load_run(spark: SparkSession, folder: str) -> DataFrame:  # S25
    return spark.read.schema(FINDING).parquet(f"{folder}/findings")


def export_json(findings: DataFrame, folder: str) -> None:  # K1, K3: absent values are left out
    findings.write.mode("overwrite").option("ignoreNullFields", "true").json(folder)
