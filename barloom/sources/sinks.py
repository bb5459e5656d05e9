"""Tables of dated Parquet partitions that are replaced as a whole, or not at all.

A version of a table is a manifest: a JSON file that names the folder of each partition and the SHA-256 of each of its files. A write
puts new folders beside the old ones and then its manifest, by a rename that fails where the version exists. Until then readers see the
version before; a write that dies half-way leaves folders that no manifest names, which ``vacuum`` removes. Two writers of one
version can't both succeed. The driver handles manifests, which name partitions and files; rows and hashes stay in Spark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import upsert

MANIFESTS = "_manifests"
#: Versions that ``vacuum`` keeps.
KEPT = 5


class Conflict(Exception):
    """Another writer has made this version."""


class Damaged(Exception):
    """Files are absent or differ from their manifest."""


def _files(spark: SparkSession, root: str):
    """The file system of a folder and its type of paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _files(spark, root)
    folder = path(f"{root}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The newest manifest or that of a version; an empty one, version 0, before the first write."""
    have = versions(spark, root)
    if version is None and not have:
        return {"version": 0, "partitions": {}, "schema": None}
    text = spark.read.option("wholetext", True).text(f"{root}/{MANIFESTS}/{have[-1] if version is None else version}.json").first()[0]
    return json.loads(text)


def hashes(spark: SparkSession, folders: list[str]) -> dict[str, dict[str, str]]:
    """Folder -> name and SHA-256 of its data files, computed where they are read. A file is one row there; writers bound its size."""
    if not folders:
        return {}
    read = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", True).load(folders)
    out: dict[str, dict[str, str]] = {f: {} for f in folders}
    for row in read.select("path", F.sha2("content", 256).alias("sha")).collect():
        folder = next(f for f in folders if f"{_plain(row.path)}/".startswith(f"{_plain(f)}/"))
        out[folder][_plain(row.path)[len(_plain(folder)) + 1 :]] = row.sha
    return out


def _plain(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path.split("/", 1)[0] else path


def _commit(spark: SparkSession, root: str, content: dict) -> None:
    fs, path = _files(spark, root)
    target, part = path(f"{root}/{MANIFESTS}/{content['version']}.json"), path(f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    # Local file systems would replace the target: look first; stores with an atomic rename refuse it themselves.
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise Conflict(f"version {content['version']} of {root} exists")


def read_table(spark: SparkSession, root: str, version: int | None = None, dates: list[str] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its dates; None before the first write."""
    from pyspark.sql import types as T

    content = manifest(spark, root, version)
    if content["schema"] is None:
        return None
    schema = T.StructType.fromJson(content["schema"])
    folders = [f"{root}/{p['folder']}" for d, p in content["partitions"].items() if dates is None or d in dates]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_into(root: str, delta: DataFrame, keys: list[str], order: str, date: str = "date") -> int:
    """Merges rows into the partitions of their dates: for each key the row with the greatest ``order``, at equal ones the new. Returns the version.

    Only the dates of ``delta`` are read and written, one folder each. Rows without a date go to a partition of their own.
    """
    spark = delta.sparkSession
    before = manifest(spark, root)
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("none"))
    dates = sorted(r[0] for r in delta.select(day).distinct().collect())  # days of one write
    old = read_table(spark, root, before["version"] or None, dates) if before["version"] else None
    rows = upsert(old, delta, keys, order) if old is not None else upsert(delta.limit(0), delta, keys, order)
    if before["schema"] is not None:
        rows = rows.select(*[f["name"] for f in before["schema"]["fields"]], *[c for c in rows.columns if c not in {f["name"] for f in before["schema"]["fields"]}])
    name = f"data-{before['version'] + 1}-{uuid.uuid4().hex}"
    rows.withColumn("_day", day).repartition("_day").write.partitionBy("_day").parquet(f"{root}/{name}")
    fs, path = _files(spark, root)
    new = {d: f"{name}/_day={d}" for d in dates if fs.exists(path(f"{root}/{name}/_day={d}"))}
    sums = hashes(spark, [f"{root}/{f}" for f in new.values()])
    partitions = {d: p for d, p in before["partitions"].items() if d not in dates} | {d: {"folder": f, "files": sums[f"{root}/{f}"]} for d, f in new.items()}
    _commit(spark, root, {"version": before["version"] + 1, "partitions": partitions, "schema": json.loads(rows.schema.json())})
    return before["version"] + 1


def verify(spark: SparkSession, root: str, version: int | None = None) -> None:
    """Raises ``Damaged`` if a file of a version is absent or has other bytes than when it was written, or if one has come to it."""
    content = manifest(spark, root, version)
    fs, path = _files(spark, root)
    gone = [p["folder"] for p in content["partitions"].values() if not fs.exists(path(f"{root}/{p['folder']}"))]
    if gone:
        raise Damaged(f"no folder {gone[0]}")
    found = hashes(spark, [f"{root}/{p['folder']}" for p in content["partitions"].values()])
    for p in content["partitions"].values():
        if found[f"{root}/{p['folder']}"] != p["files"]:
            raise Damaged(f"files of {p['folder']} differ from the manifest")


def vacuum(spark: SparkSession, root: str, kept: int = KEPT) -> list[str]:
    """Removes versions but the newest and the folders that none of these names. Not to run beside a write. Returns the names of what went."""
    fs, path = _files(spark, root)
    have = versions(spark, root)
    named = {p["folder"].split("/", 1)[0] for v in have[-kept:] for p in manifest(spark, root, v)["partitions"].values()}
    gone = []
    for v in have[:-kept]:
        fs.delete(path(f"{root}/{MANIFESTS}/{v}.json"), False)
        gone.append(f"{v}.json")
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in named:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone


def save_model(spark: SparkSession, model, root: str) -> int:
    """A fitted model as the next version of an artifact, with the hashes of its files."""
    before = manifest(spark, root)
    name = f"data-{before['version'] + 1}-{uuid.uuid4().hex}/model"
    model.write().save(f"{root}/{name}")
    sums = hashes(spark, [f"{root}/{name}"])
    _commit(spark, root, {"version": before["version"] + 1, "partitions": {"model": {"folder": name, "files": sums[f"{root}/{name}"]}}, "schema": None})
    return before["version"] + 1


def load_model(spark: SparkSession, kind: type, root: str, version: int | None = None):
    """A model of a version behind a check of its hashes. ``kind`` is its class."""
    content = manifest(spark, root, version)
    if not content["partitions"]:
        raise Damaged(f"{root} has no version")
    verify(spark, root, version)
    return kind.load(f"{root}/{content['partitions']['model']['folder']}")
