"""Content fingerprints, version look-ups and skipping of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16  # a 256-bit row hash is added up in 16-bit parts, so whole-number sums stay exact for 10**14 rows
ID_LENGTH = 12
SEPARATOR = chr(31)
MISSING = chr(30)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row. Line ends CRLF and LF are the same, a missing value differs from an empty one."""
    parts = []
    for name in columns or df.columns:
        c = F.col(name).cast("string")
        if isinstance(df.schema[name].dataType, T.StringType):
            c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
        parts.append(F.coalesce(c, F.lit(MISSING)))
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def dataset_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(version, row_count): equal rows give an equal id, whatever their order, partitions or files.

    Row hashes are added up part by part (a multiset hash), so each task sends one row and repeated rows
    count. The header takes part: other column names give another id.
    """
    names = columns or df.columns
    hashed = df.select(row_hash(df, names).alias("h"))
    sums = [
        F.sum(F.conv(F.substring("h", 4 * i + 1, 4), 16, 10).cast("bigint")).alias(f"s{i}") for i in range(PARTS)
    ]
    total = hashed.agg(F.count("*").alias("row_count"), *sums)
    digest = F.concat_ws(",", F.lit("|".join(names)), F.col("row_count"), *[F.col(f"s{i}") for i in range(PARTS)])
    return total.select(F.substring(F.sha2(digest, 256), 1, ID_LENGTH).alias("version"), "row_count")


def folder_fingerprint(listing: DataFrame, root: str, formats: tuple[str, ...]) -> DataFrame:
    """(version, files) of a file listing (path, length): names and sizes, contents unread.

    Lines ``relative path:size`` are added up as a multiset, as rows are in ``dataset_fingerprint``.
    """
    relative = F.regexp_replace("path", "^.*" + _quoted(root.rstrip("/")) + "/", "")
    wanted = listing.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*[f.lower() for f in formats]))
    lines = wanted.select(F.concat_ws(":", relative, F.col("length").cast("string")).alias("line"))
    out = dataset_fingerprint(lines, ["line"])
    return out.withColumnRenamed("row_count", "files")


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in "/_" else ch for ch in text)


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of whole files from the ``binaryFile`` source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def pending_work(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key and signature the ledger does not hold as finished."""
    return wanted.join(ledger.select(*keys).distinct(), keys, "left_anti")


def latest_version(versions: DataFrame, dataset: str, version: str, at: str) -> DataFrame:
    """(dataset, version, at): the newest version of each dataset; of equal times the larger id."""
    newest = F.max(F.struct(F.col(at).alias("at"), F.col(version).alias("version"))).alias("newest")
    return versions.groupBy(F.col(dataset).alias("dataset")).agg(newest).select("dataset", "newest.version", "newest.at")


def version_mismatch(batches: DataFrame, reference: DataFrame, dataset: str, version: str) -> DataFrame:
    """Batches with the reference's version beside their own and whether the two differ."""
    ref = reference.select(dataset, F.col(version).alias("reference_version"))
    return batches.join(ref, dataset, "left").withColumn(
        "version_mismatch", ~F.col(version).eqNullSafe(F.col("reference_version"))
    )
