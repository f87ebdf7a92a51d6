"""Progress ledger persistence (O05): versioned snapshots committed by a manifest.

``<path>/data/<name>`` holds one snapshot as parquet, ``<path>/manifest/<version>`` one line of JSON that names it.  A
version exists once its manifest does, and a manifest is created only where there is none, so of two writers that
start from one version one fails.  A save that fails before its manifest leaves the version before it as it was; a
manifest that cannot be read is passed over.  Readers hold a snapshot's own folder, so a ledger can be saved to the
path that it was loaded from.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.progress import LEDGER_SCHEMA, empty_ledger, normalize_ledger

FORMAT = 1
#: Versions that a save leaves in place; older snapshots are removed.
KEEP = 8


class LedgerConflict(RuntimeError):
    """Another writer has committed the version that this save was to make."""


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, function from a sub-path to its Path)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    if not fs.exists(at("manifest")):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at("manifest")) if f.getPath().getName().isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict | None:
    """A version's manifest; None if its writer did not finish it."""
    fs, at = _files(spark, path)
    stream = fs.open(at("manifest", f"{version:012d}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "data" in found else None


def ledger_version(spark: SparkSession, path: str) -> int:
    """The newest readable version, 0 for a ledger that was never saved."""
    return next((v for v in reversed(_versions(spark, path)) if _manifest(spark, path, v)), 0)


def load_progress(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The ledger as of a version (the newest).  Never saved -> empty ledger; another format or wrong shape -> ValueError."""
    version = ledger_version(spark, path) if version is None else version
    if version == 0:
        fs, at = _files(spark, path)
        if not fs.exists(at("")) or fs.exists(at("manifest")):
            return empty_ledger(spark)
        folder = path  # a plain table from before versions
    else:
        found = _manifest(spark, path, version) if version in _versions(spark, path) else None
        if found is None or found.get("format") != FORMAT:
            raise ValueError("Checkpoint table is invalid or from an incompatible version")
        folder = f"{path.rstrip('/')}/data/{found['data']}"
    df = spark.read.parquet(folder)
    names = LEDGER_SCHEMA.fieldNames()
    if not set(names) <= set(df.columns):
        raise ValueError("Checkpoint table is invalid or from an incompatible version")
    return normalize_ledger(df.select(*names))


def save_progress(ledger: DataFrame, path: str, expected: int | None = None) -> int:
    """Commit ``ledger`` as the next version and return its number.  With ``expected``, the version that it was made
    from, LedgerConflict if another one was committed since."""
    spark, root = ledger.sparkSession, path.rstrip("/")
    base = ledger_version(spark, path) if expected is None else expected
    if expected is not None and ledger_version(spark, path) != expected:
        raise LedgerConflict(f"the ledger is not at version {expected} any more")
    name = uuid.uuid4().hex
    normalize_ledger(ledger).write.parquet(f"{root}/data/{name}")
    version = max([base, *_versions(spark, path)]) + 1 if expected is None else _next_free(spark, path, base)
    fs, at = _files(spark, path)
    try:
        stream = fs.create(at("manifest", f"{version:012d}"), False)  # never over another one
    except Exception as e:
        if fs.exists(at("manifest", f"{version:012d}")):
            raise LedgerConflict(f"version {version} of the ledger was committed by another writer") from e
        raise
    try:
        stream.write(bytearray(json.dumps({"format": FORMAT, "data": name, "base": base}).encode()))
    finally:
        stream.close()
    _drop_old(spark, path)
    return version


def _next_free(spark: SparkSession, path: str, base: int) -> int:
    """The version after ``base``, passing over unreadable manifests; LedgerConflict if a readable one follows."""
    after = [v for v in _versions(spark, path) if v > base]
    if any(_manifest(spark, path, v) for v in after):
        raise LedgerConflict(f"the ledger is not at version {base} any more")
    return max([base, *after]) + 1


def _drop_old(spark: SparkSession, path: str) -> None:
    """Remove all but the newest ``KEEP`` versions, manifests first."""
    fs, at = _files(spark, path)
    for v in _versions(spark, path)[:-KEEP]:
        found = _manifest(spark, path, v)
        fs.delete(at("manifest", f"{v:012d}"), False)
        if found:
            fs.delete(at("data", found["data"]), True)
