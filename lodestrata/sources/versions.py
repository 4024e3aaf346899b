"""Numbered versions of a folder: each is one small file that says what belongs to it.

A commit creates the file of the next number, which only succeeds if no other commit did so before; what it names was written
before, under names that nobody else uses. So readers see all of a version or nothing of it, of two writers that begin from
one version one fails, and a version only names what it adds: the rest is named again, not written again.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.storage import shared_dir


class Conflict(RuntimeError):
    """Another commit came first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _file(path: str, number: int) -> str:
    return f"{path}/_versions/{number:012d}.json"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, finished or not, ascending."""
    fs, folder = _fs(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def content(spark: SparkSession, path: str, number: int) -> dict[str, Any] | None:
    """What a version says; None while its file is being written."""
    fs, file = _fs(spark, _file(path, number))
    stream = fs.open(file)
    try:
        said = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(said)
    except ValueError:
        return None


def newest(spark: SparkSession, path: str) -> tuple[int, dict[str, Any]]:
    """Number and content of the newest finished version; (0, {}) if there is none."""
    for number in reversed(numbers(spark, path)):
        if (found := content(spark, path, number)) is not None:
            return number, found
    return 0, {}


def commit(spark: SparkSession, path: str, after: int, said: dict[str, Any]) -> int:
    """Makes `said` the version that follows number `after`; raises Conflict if that has a successor already.

    A file that a crash left unfinished blocks further commits until it is deleted.
    """
    number = after + 1
    if any(n > after for n in numbers(spark, path)):
        raise Conflict(f"{path} has a version after {after}")
    fs, file = _fs(spark, _file(path, number))
    fs.mkdirs(file.getParent())
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        raise Conflict(f"{path} has a version {number}") from e
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    return number


def beside(table: DataFrame, kind: str, *words: str) -> str:
    """A path in the shared folder for what is derived from a table's files as they are now: other files, another path."""
    spark, state = table.sparkSession, [kind, *words]
    for file in sorted(table.inputFiles()):
        fs, p = _fs(spark, file)
        status = fs.getFileStatus(p)
        state.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    name = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(state)).hex
    return f"{shared_dir(spark, kind).rsplit('/', 1)[0]}/{kind}-of-{name}"
