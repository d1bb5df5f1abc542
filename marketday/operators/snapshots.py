"""Tables whose days are replaced by new versions: a reader sees one whole version, before, during and after a rebuild.

Below a table's folder ``data/batch=<id>/<day>=<value>`` holds rows and is never changed once written.  A manifest says for each
day which batch holds it; ``commits/<version>`` is one small file that names the manifest, and creating it is the commit.
What a run leaves behind that ends before its commit is not named by anything and not read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketday.operators.rebuild import in_window
from marketday.session import _at, drop_path, exists

NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder Spark gives to rows without a day
ID_CHARS = 32


class Overtaken(RuntimeError):
    """Another run has committed days that this one replaces."""


class SnapshotTable:
    """A Parquet table below ``path``, one folder for each ``day`` of a batch; ``schema`` holds the day column, a date."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, day: str = "date"):
        self.spark, self.path, self.day = spark, path, day
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # ---- small files ------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        fs, at = _at(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _create(self, name: str, text: str) -> bool:
        """False where the file is there already: of several runs only one creates it."""
        fs, at = _at(self.spark, f"{self.path}/{name}")
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)
        except Exception as error:  # noqa: BLE001 - the JVM's error tells whether another run was first
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, name: str) -> str:
        fs, at = _at(self.spark, f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    # ---- versions -----------------------------------------------------------------------------------

    def versions(self) -> dict[int, str]:
        """Version -> manifest.  A commit file that its writer did not finish counts as none."""
        named = {int(n): self._text(f"commits/{n}") for n in self._names("commits") if n.isdigit()}
        return {v: text for v, text in sorted(named.items()) if len(text) == ID_CHARS}

    def days(self, version: int | None = None) -> dict[str, str]:
        """Day (as its folder says it) -> batch; empty while nothing is committed."""
        known = self.versions()
        if version is None and not known:
            return {}
        if version is None:
            version = max(known)
        if version not in known:
            raise KeyError(f"{self.path} has no version {version}")
        return json.loads(self._text(f"manifests/{known[version]}.json"))

    def note(self, version: int | None = None) -> dict:
        """What was committed along with the newest version, or the one asked for; empty where nothing was."""
        known = self.versions()
        manifest = known.get(max(known, default=0) if version is None else version)
        name = f"notes/{manifest}.json"
        return json.loads(self._text(name)) if manifest and exists(self.spark, f"{self.path}/{name}") else {}

    def read(self, version: int | None = None, since: dt.date | None = None) -> DataFrame:
        """The newest version, or the one asked for; ``since`` leaves earlier days (and rows without one) unlisted."""
        days = self.days(version)
        if since is not None:
            days = {d: b for d, b in days.items() if d != NO_DAY and d >= since.isoformat()}
        if not days:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/data/batch={b}/{self.day}={d}" for d, b in sorted(days.items())]
        found = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*self.schema.fieldNames())

    # ---- writing --------------------------------------------------------------------------------------

    def _replaced(self, days: dict[str, str], cutoff: dt.date | None, only: set[str] | None = None) -> set[str]:
        if only is not None:
            return set(days) & only
        return {d for d in days if cutoff is None or (d != NO_DAY and d >= cutoff.isoformat())}

    def rebuild(self, fresh: DataFrame, cutoff: dt.date | None, watch: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Replace all days from ``cutoff`` on (all rows, where it is None) by ``fresh``; rows written.

        One distributed write of the window, then one commit.  Days without fresh rows end with the version: no job of
        their own.  History is neither read nor copied.  Runs on other days may commit in between and are kept;
        a run that finds a day of its window changed meanwhile ends with :class:`Overtaken` and changes nothing.
        ``watch`` is given the rows right before they are written; further columns of ``fresh`` reach it and end there.
        """
        base = self.days()
        if cutoff is not None:
            fresh = fresh.filter(in_window(F.col(self.day), cutoff))
        folder, written = self._batch(fresh, watch)
        self.commit(written, cutoff, base)
        return self._rows(folder, written)

    def replace(self, fresh: DataFrame, days: set[dt.date | None], note: dict, seen: dict) -> int:
        """Replace the named days (None: rows without one) by ``fresh``, which holds no others, and commit ``note`` with them; rows written.

        Days and note change together or not at all.  ``seen`` is the note that this run started from: where another
        run has committed a new one or any of the days, this one ends with :class:`Overtaken`.
        """
        base = self.days()
        folder, written = self._batch(fresh)
        only = {NO_DAY if d is None else d.isoformat() for d in days}
        if not set(written) <= only:
            raise ValueError(f"rows of days that are not replaced: {sorted(set(written) - only)[:10]}")
        self.commit(written, None, base, only, note, seen)
        return self._rows(folder, written)

    def _batch(self, fresh: DataFrame, watch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, dict[str, str]]:
        """Rows written as a batch of their own: its folder, and the days it holds."""
        batch = uuid.uuid4().hex
        folder = f"data/batch={batch}"
        columns = self.schema.fieldNames()
        if watch is None:
            dealt = fresh.select(*columns).hint("rebalance", F.col(self.day))
        else:
            dealt = watch(fresh.hint("rebalance", F.col(self.day))).select(*columns)
        dealt.write.partitionBy(self.day).parquet(f"{self.path}/{folder}")
        return folder, {n.split("=", 1)[1]: batch for n in self._names(folder) if n.startswith(f"{self.day}=")}

    def _rows(self, folder: str, written: dict[str, str]) -> int:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count() if written else 0  # from footers

    def commit(
        self, written: dict[str, str], cutoff: dt.date | None, base: dict[str, str],
        only: set[str] | None = None, note: dict | None = None, seen: dict | None = None,
    ) -> int:
        """The version in which ``written`` stands for all days from the cutoff on, or for those in ``only``; a note stays until it is replaced."""
        while True:
            now, said = self.days(), self.note()
            mine = self._replaced(now | base | written, cutoff, only)
            if any(now.get(d) != base.get(d) for d in mine) or (note is not None and said != seen):
                raise Overtaken(f"{self.path}: what this run replaces was committed by another run")
            days = {d: b for d, b in now.items() if d not in mine} | written
            manifest = uuid.uuid4().hex
            self._create(f"manifests/{manifest}.json", json.dumps(days, sort_keys=True))
            if note is not None or said:
                self._create(f"notes/{manifest}.json", json.dumps(said if note is None else note, sort_keys=True))
            numbers = [int(n) for n in self._names("commits") if n.isdigit()]
            version = max(numbers, default=0) + 1
            # what is committed may have changed since it was read only where a newer version exists
            if self.days() == now and self.note() == said and self._create(f"commits/{version:012d}", manifest):
                return version

    def expire(self, keep: int = 2) -> int:
        """Remove what only versions older than the newest ``keep`` name; folders removed.

        For a time when no run writes: what a running job has not committed yet is named by no version either.
        """
        known = self.versions()
        gone = sorted(known)[: max(0, len(known) - max(1, keep))]
        live = {(b, d) for v in set(known) - set(gone) for d, b in self.days(v).items()}
        removed = 0
        for name in self._names("data"):
            own = name.split("=", 1)[1]
            parts = [n for n in self._names(f"data/{name}") if n.startswith(f"{self.day}=")]
            dead = [n for n in parts if (own, n.split("=", 1)[1]) not in live]
            for n in [""] if len(dead) == len(parts) else dead:
                drop_path(self.spark, f"{self.path}/data/{name}/{n}".rstrip("/"))
                removed += 1
        for v in gone:
            drop_path(self.spark, f"{self.path}/commits/{v:012d}")
            drop_path(self.spark, f"{self.path}/manifests/{known[v]}.json")
            drop_path(self.spark, f"{self.path}/notes/{known[v]}.json")
        return removed


def is_snapshot(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/commits")
