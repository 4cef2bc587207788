"""Versioned stores of the registry and its exports and imports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.page import LEXICON, SEASONS

STATUSES = ["candidate", "active", "stale", "parked", "pinned", "excluded"]
RECORD = (
    "url string, domain string, label string, status string, dealDensity double, changeRate double, finalScore double, avgProductCount double, consecutiveMisses int, checkCount long, successCount long, "
    "nextCheckAt long, revisitAfter long, lastVerifiedAt long, lastSeenAt long, evidence array<string>, seasonHint array<int>"
)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(table: DataFrame, path: str) -> int:
    """Write the next version beside the last, then publish it; the one before it is kept.

    A version is published by renaming its folder, so a reader sees the old one or the new one, whole.
    """
    spark = table.sparkSession
    fs, root = _fs(spark, path)
    fs.mkdirs(root)
    done = versions(spark, path)
    n = (done[-1] if done else 0) + 1
    table.write.mode("overwrite").parquet(f"{path}/.writing-{n}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(jpath(f"{path}/.writing-{n}"), jpath(f"{path}/v={n}")):
        raise OSError(f"cannot publish version {n} of {path}")
    for old in done[:-1]:
        fs.delete(jpath(f"{path}/v={old}"), True)
    return n


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version that can be read, the one before it if not, an empty table without any; rows need a url."""
    for n in reversed(versions(spark, path)):
        try:
            df = spark.read.schema(schema).parquet(f"{path}/v={n}")
            df.limit(1).collect()
            return df.where(F.col("url").isNotNull()) if "url" in df.columns else df
        except Exception:  # noqa: BLE001 - a damaged version, whatever Spark calls it
            continue
    return spark.createDataFrame([], schema)


def export_json(table: DataFrame, path: str) -> None:
    """A18."""
    table.write.mode("errorifexists").json(path)


def sanitize(raw: DataFrame, body: str = "body") -> DataFrame:
    """Imported records from JSON texts (ord, body): url required, ids recomputed, odd values replaced."""
    r = F.col("r")
    n = lambda c, d=0: F.coalesce(r[c], F.lit(d))
    rows = raw.select("ord", F.from_json(body, RECORD).alias("r")).where(F.coalesce(r["url"], F.lit("")) != "")
    strings = F.slice(F.filter(F.coalesce(r["evidence"], F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, 20)
    months = F.filter(F.coalesce(r["seasonHint"], F.array().cast("array<int>")), lambda m: m.between(1, 12))
    return rows.select(
        "ord",
        F.substring(F.sha1(r["url"].cast("binary")), 1, 16).alias("id"),
        *(r[c].alias(c) for c in ("url", "domain", "label")),
        F.when(r["status"].isin(STATUSES), r["status"]).otherwise("candidate").alias("status"),
        *(n(c, 0.0).alias(c) for c in ("dealDensity", "changeRate", "finalScore", "avgProductCount")),
        *(n(c).alias(c) for c in ("consecutiveMisses", "checkCount", "successCount", "nextCheckAt")),
        *(r[c].alias(c) for c in ("revisitAfter", "lastVerifiedAt", "lastSeenAt")),
        strings.alias("evidence"),
        months.alias("seasonHint"),
    )


def lexicon_from(text: str) -> tuple[dict[float, list[str]], dict[str, list[int]]]:
    """The lexicon with a user's JSON on top (A, BN: 1.0, B: 0.9, C: 0.45, SEASON: months of a term)."""
    own = json.loads(text)
    out = {w: list(terms) for w, terms in LEXICON.items()}
    for key, weight in (("A", 1.0), ("B", 0.9), ("C", 0.45), ("BN", 1.0)):
        for term in own.get(key, ()):
            for terms in out.values():
                if term in terms:
                    terms.remove(term)
            out[weight].append(" ".join(term.lower().split()))
    return out, {**SEASONS, **own.get("SEASON", {})}
