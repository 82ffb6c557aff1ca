"""Model store (K1, S9, S10): sets of fitted models in versions that never change.

``<root>/versions/<id>`` holds one whole set: the models, linear sets as one
table each, and ``registry``, a Parquet table {domain, classifier, kind, path,
labels, width, place}.  A version is published, after all of it is written, by
creating the empty file ``<root>/log/<number>.<id>``; the version with the
greatest number is the current one.  So a reader sees a whole set or none: a
save that dies half-way leaves a folder that no log entry names, removed
models are not in the next version's registry, and a reader that keeps a
version's id reads the same models however often the set is saved again.

``publish`` and ``current`` do the same for any derived table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import linear as LN
from parlance.operators.train import TextModel

SCHEMA = ("domain string, classifier string, kind string, path string, labels array<string>, width int, place int")


def _fs(spark: SparkSession, path: str):
    """(file system, path object) of the cluster's storage layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, id) of the published versions, oldest first; two of one number are told apart by id."""
    fs, at = _fs(spark, f"{root}/log")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n), i) for n, _, i in (x.partition(".") for x in names) if n.isdigit() and i)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest published version, None where nothing is."""
    found = versions(spark, root)
    return f"{root}/versions/{found[-1][1]}" if found else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Writes a new version by ``write(folder)`` and makes it the current one; returns its folder."""
    name = uuid.uuid4().hex
    folder = f"{root}/versions/{name}"
    write(folder)
    found = versions(spark, root)
    number = found[-1][0] + 1 if found else 1
    fs, at = _fs(spark, f"{root}/log/{number:012d}.{name}")
    if not fs.createNewFile(at):
        raise FileExistsError(at.toString())
    return folder


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all but the last ``keep`` published versions; returns the ids removed.

    A version's log entry goes first, so no reader starts on what is being removed.
    """
    old = versions(spark, root)[:-keep] if keep else versions(spark, root)
    for number, name in old:
        fs, at = _fs(spark, f"{root}/log/{number:012d}.{name}")
        fs.delete(at, False)
        fs, at = _fs(spark, f"{root}/versions/{name}")
        fs.delete(at, True)
    return [name for _, name in old]


def save_models(spark: SparkSession, models: Sequence[TextModel | LN.LinearSet], root: str) -> DataFrame:
    """Saves the models as a new version of the root's set; returns its registry.

    A linear set of any number of models is one table, each other model a folder.
    """
    def write(folder: str) -> None:
        rows = []
        for n, tm in enumerate(models):
            if isinstance(tm, LN.LinearSet):
                path = f"{folder}/linear-{n}"
                LN.to_table(spark, tm).write.parquet(path)
                rows += [(d, c, "intent", path, None, tm.width, i)
                         for i, (d, c) in enumerate(zip(tm.domains, tm.classifiers, strict=True))]
            else:
                path = f"{folder}/{tm.domain}/{tm.classifier}"
                tm.model.write().save(path)
                rows.append((tm.domain, tm.classifier, tm.kind, path, list(tm.labels), int(tm.num_features), None))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/registry")

    return registry(spark, root, publish(spark, root, write))


def registry(spark: SparkSession, root: str, version: str | None = None) -> DataFrame | None:
    """The registry of a version (a folder that ``current`` gave; default: the current one), None where nothing is."""
    folder = version or current(spark, root)
    return None if folder is None else spark.read.schema(SCHEMA).parquet(f"{folder}/registry")


def _rows(spark: SparkSession, root: str, domain: str | None, kind: str | None, version: str | None) -> list:
    rows = registry(spark, root, version)
    if rows is None:
        raise FileNotFoundError(f"no models saved in {root}")
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return sorted(rows.collect(), key=lambda r: (r["domain"], r["classifier"]))  # a row per model


def load_models(spark: SparkSession, root: str, domain: str | None = None, kind: str | None = None,
                version: str | None = None) -> list[TextModel]:
    """The pipeline models of a set, or those of a domain and/or kind, in (domain, classifier) order."""
    return [TextModel(r["domain"], r["classifier"], r["kind"], PipelineModel.load(r["path"]), list(r["labels"]), r["width"])
            for r in _rows(spark, root, domain, kind, version) if r["place"] is None]


def load_linear(spark: SparkSession, root: str, domain: str | None = None, version: str | None = None) -> LN.LinearSet:
    """The linear models of a set, or those of a domain, in (domain, classifier) order."""
    rows = [r for r in _rows(spark, root, domain, "intent", version) if r["place"] is not None]
    paths = {r["path"]: r["width"] for r in rows}
    if len(set(paths.values())) > 1:
        raise ValueError(f"linear models of several widths in {root}")
    parts = {p: LN.from_table(spark.read.parquet(p), w) for p, w in paths.items()}
    picked = [(parts[r["path"]], r["place"]) for r in rows]
    return LN.LinearSet(tuple(r["domain"] for r in rows), tuple(r["classifier"] for r in rows),
                        LN.stack([p.coefficients[i] for p, i in picked], next(iter(paths.values()), 0)),
                        LN.stack([p.intercepts[i] for p, i in picked]))
