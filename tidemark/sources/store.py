"""Result tables that outlive a run: blocks that are replaced one by one, and results kept by the content they were computed from.

A store is a folder. Every block of a version is a folder of Parquet of its own; a version is a
small list of blocks and their folders, named by its number and put in place by a rename once all
its blocks are written. Readers take the last version in place. So a run that fails half-way leaves
the version before it whole, a run replaces its own blocks and keeps the others, and of two runs that
publish the same number one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.scan import same

HEX = 15  # hexadecimal digits of a digest that add up without loss


class Store:
    """Versions of named tables in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        with_stream = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()

    def version(self) -> int:
        """Number of the last version in place; 0 for a new store."""
        top = self._path(f"{self.folder}/versions")
        if not self.fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(top)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def blocks(self, version: int | None = None) -> dict[str, list[str]]:
        """Block name to its folders, of a version (the last)."""
        n = self.version() if version is None else version
        return json.loads(self._text(f"{self.folder}/versions/{n:09d}.json")) if n else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A block's table; an error if the version has none of that name."""
        found = self.blocks(version)
        if name not in found:
            raise KeyError(name)
        return self.spark.read.parquet(*(f"{self.folder}/{part}" for part in found[name]))

    def publish(self, tables: Mapping[str, DataFrame], drop: tuple[str, ...] = (), add: Mapping[str, DataFrame] | None = None) -> int:
        """Writes the tables as blocks, appends those of ``add`` to theirs, keeps all other blocks, and puts the next version in place; its number."""
        base = self.version()
        kept, made = {k: v for k, v in self.blocks(base).items() if k not in drop}, {}
        for name, table in [*tables.items(), *(add or {}).items()]:
            part = f"blocks/{uuid.uuid4().hex}"
            table.write.parquet(f"{self.folder}/{part}")
            made[name] = [*(kept.get(name, []) if name not in tables else []), part]
        self._place(base + 1, json.dumps({**kept, **made}, sort_keys=True))
        return base + 1

    def _place(self, number: int, text: str) -> None:
        final = f"{self.folder}/versions/{number:09d}.json"
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        for d in ("versions", "drafts"):
            self.fs.mkdirs(self._path(f"{self.folder}/{d}"))
        out = self.fs.create(self._path(draft), False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        # a rename onto a file that is there fails on file systems that tables are kept on; where it would not, the check says so
        if self.fs.exists(self._path(final)) or not self.fs.rename(self._path(draft), self._path(final)):
            raise RuntimeError(f"version {number} of {self.folder} was published by another run")


def digits(*columns: Column) -> Column:
    """A row's digest as a whole number below 16 ** HEX; null and an empty text differ."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("decimal(38,0)")


def fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fingerprint): of all rows of a key, in whatever order they stand and however they are dealt; a repeated row counts.

    The number of rows, and the sums of two digests of each row, one of them of the row twice over:
    one aggregation, of three numbers per key.
    """
    one, two = digits(*(F.col(c) for c in columns)), digits(*(F.col(c) for c in columns), F.lit("again"))
    g = rows.groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), F.sum(one).cast("string").alias("_a"), F.sum(two).cast("string").alias("_b"))
    return g.select(*keys, F.md5(F.concat_ws(":", "_n", "_a", "_b").cast("binary")).alias("fingerprint"))


def kept(store: Store, name: str, rows: DataFrame, keys: list[str], columns: list[str], settings: Mapping[str, object], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Results of ``compute`` for every key of ``rows``, computed only for keys whose content or settings are new; and the number of those keys.

    ``compute`` gets the rows of the new keys and returns a table with the key columns. Results are
    kept by the key's fingerprint over ``columns`` and by ``settings``, which should name everything
    else that determines them, the version of the code included. A key that has no result is kept
    as such. Nothing is computed, and nothing written, when all are known. Under several
    fingerprints of a key, those of its present content count.
    """
    setting = json.dumps(dict(settings), sort_keys=True, default=str)
    marks = fingerprints(rows, keys, columns).withColumn("setting", F.lit(setting))
    done, results = f"{name}.done", f"{name}.results"
    known = store.blocks()
    by = [*keys, "fingerprint", "setting"]
    new = same(marks, store.read(done), by, "left_anti") if done in known else marks
    todo = new.persist()
    try:
        n = todo.count()
        if n:
            made = same(compute(same(rows, todo.select(*keys), keys, "left_semi")), todo, keys)
            store.publish({}, add={done: todo, results: made})
    finally:
        todo.unpersist()
    return same(store.read(results), marks, by, "left_semi").drop("fingerprint", "setting"), n
