"""Processed tables kept between sessions, for as long as their input stays what it is and for a limited time.

A table lies in ``folder/name/<fingerprint>/<creation time in ms>``; Spark's _SUCCESS file says that it is whole. The
fingerprint covers path, size and modification time of every input file and the version of the definition, so a changed
input or definition finds no table and computes anew. The folders are the manifest: there is no other record that could
disagree with them, and two sessions that compute the same table at once write two folders, of which the newer is read.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from anomalytics.session import ensure_checkpoint_dir, file_system, is_written

TTL_SECONDS = 3600.0
LEASE_SECONDS = 6 * 3600.0


def input_fingerprint(spark: SparkSession, paths: Iterable[str], version: str = "1") -> str:
    """Hash of (path, size, modification time) of all files under ``paths`` and of ``version``.

    Names that begin with ``_`` or ``.`` are no data. A path that does not exist is an error.
    """
    seen = []
    for path in paths:
        store, jpath = file_system(spark, path)
        files = store.listFiles(jpath, True)
        while files.hasNext():
            status = files.next()
            if not status.getPath().getName().startswith(("_", ".")):
                seen.append(f"{status.getPath().toString()}\t{status.getLen()}\t{status.getModificationTime()}")
    return hashlib.sha256("\n".join([version, *sorted(set(seen))]).encode()).hexdigest()[:32]


class KeptTables:
    """Kept tables under ``folder``; by default ``kept`` in the shared folder that ``spark.checkpoint.dir`` names.

    A table is handed out until it is ``ttl`` seconds old. It is deleted once ``lease`` more seconds have passed: whoever
    got it may read it for that long. A write that was never finished goes at the same time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, ttl: float = TTL_SECONDS,
                 lease: float = LEASE_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.ttl, self.lease, self.clock = spark, ttl, lease, clock
        shared = folder or (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/") + "/kept"
        self.folder = shared.rstrip("/")

    def get(self, name: str, inputs: Iterable[str], build: Callable[[], DataFrame], version: str = "1") -> DataFrame:
        """The kept table of these inputs, or ``build()`` written and read back. Expired tables are deleted first."""
        self.sweep()
        home = f"{self.folder}/{name}/{input_fingerprint(self.spark, inputs, version)}"
        now = self.clock()
        fresh = [made for made in self._made(home) if now - made / 1000 < self.ttl and is_written(self.spark, f"{home}/{made}")]
        if not fresh:
            fresh = [int(now * 1000)]
            build().write.parquet(f"{home}/{fresh[0]}")
        return self.spark.read.parquet(f"{home}/{max(fresh)}")

    def sweep(self) -> int:
        """Delete what is past its time and its lease; returns the number of tables deleted."""
        store, _ = file_system(self.spark, self.folder)
        gone = 0
        for named in self._folders(self.folder):
            for home in self._folders(named):
                for old in [m for m in self._made(home) if self.clock() - m / 1000 >= self.ttl + self.lease]:
                    gone += bool(store.delete(file_system(self.spark, f"{home}/{old}")[1], True))
        return gone

    def _folders(self, folder: str) -> list[str]:
        store, jpath = file_system(self.spark, folder)
        if not store.exists(jpath):
            return []
        return [s.getPath().toString() for s in store.listStatus(jpath) if s.isDirectory()]

    def _made(self, home: str) -> list[int]:
        names = [path.rsplit("/", 1)[1] for path in self._folders(home)]
        return sorted(int(n) for n in names if n.isdigit())
