"""Tables as layers of immutable folders, and manifests that name the layers of each.

A table is a list of layers, oldest first. A layer has rows, and keys that are gone: rows of older layers with one of these keys don't count any more. So
a commit that replaces a few sessions writes their rows and names, whatever the size of the table, and a table that is written whole has one layer. Rows of a
table with parts are stored by a hash of its key, so that what a few keys have is read from their parts alone. Layers of like size
are merged, which costs a row as many writes as the logarithm of the table's size.

A commit writes new folders and then one manifest, numbered after the one that it was made from. A manifest becomes visible by a rename that fails if
its number is taken, so all tables of a commit appear at once and a crash before it changes nothing. A writer that finds its number taken puts
its layers on top of the newer manifest, if the commits in between touched none of its sessions and it wrote no table whole; else it fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that is stored by its key.
PARTS = 64
#: Layers of one size class (a power of this number of bytes) that are merged.
MERGED = 8


class Conflict(RuntimeError):
    """Another writer has changed what this one changes since the state was read."""


def part(*key: str) -> Column:
    """The part that a key is stored in."""
    return F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int")


class Snapshots:
    """keys: for each table with layers the columns that rows are replaced by; parted: those stored by part; layout: columns that rows are in order of."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, tuple[str, ...]] | None = None, parted: tuple[str, ...] = (), layout: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.parted, self.layout = keys or {}, parted, layout or {}
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # --- manifests

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _versions(self, names: list[str]) -> list[int]:
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def _manifest(self, version: int) -> dict:
        at = self._at(f"manifest-{version:012d}")
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, list[dict]]]:
        """Number of the newest manifest, 0 without one, and the layers of each table. Folders without any manifest are a damaged store."""
        names = self._names()
        versions = self._versions(names)
        if not versions:
            if any("-snapshot-" in n for n in names):
                raise ValueError(f"{self.path} has snapshots and no manifest")
            return 0, {}
        return versions[-1], self._manifest(versions[-1])["tables"]

    # --- reads

    def read(self, table: str, schema: str, keys: DataFrame | None = None, layers: list[dict] | None = None, gone: list[dict] | None = None) -> DataFrame:
        """The table's current rows, none if it was never written; with keys (its key columns), those of these keys, from their parts alone.

        layers: of these layers alone; gone: as seen by these.
        """
        layers = self.current()[1].get(table, []) if layers is None else layers
        key, wanted = list(self.keys.get(table, ())), None
        if keys is not None and table in self.parted:
            wanted = sorted(r[0] for r in keys.select(part(*key)).distinct().collect())  # PARTS rows at most
        found = []
        last = max((x["seq"] for x in gone or layers if x["gone"]), default=0)
        for x in layers:
            if not x["rows"] or (wanted is not None and x["parts"] is not None and not set(wanted) & set(x["parts"])):
                continue
            d = self.spark.read.schema(schema + (", part int" if table in self.parted else "")).parquet(f"{self.path}/{x['rows']}")
            if table in self.parted:
                d = (d if wanted is None else d.where(F.col("part").isin(wanted))).drop("part")
            found.append((x["seq"], d))
        new = [d for seq, d in found if seq >= last]
        old = [d.withColumn("_seq", F.lit(seq)) for seq, d in found if seq < last]
        if old:
            dead = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{x['gone']}").select(*key, F.lit(x["seq"]).alias("_later")) for x in gone or layers if x["gone"]])
            dead = dead.groupBy(*key).agg(F.max("_later").alias("_later"))
            d = reduce(DataFrame.unionByName, old)
            new.insert(0, d.join(dead, key, "left").where("_later IS NULL OR _seq >= _later").select(*[c for c in d.columns if c != "_seq"]))
        out = reduce(DataFrame.unionByName, new) if new else self.spark.createDataFrame([], schema)
        return out if keys is None else out.join(keys.select(*key).distinct(), key, "left_semi")

    # --- writes

    def write(self, table: str, rows: DataFrame) -> str:
        """A new folder with the rows; nothing reads it until a commit names it."""
        folder = f"{table}-snapshot-{uuid.uuid4().hex}"
        order = self.layout.get(table, ())
        out = rows
        if table in self.parted:
            out = rows.withColumn("part", part(*self.keys[table]))
            order = ("part", *order)
        if order:
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
        (out.write.partitionBy("part") if table in self.parted else out.write).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def _layer(self, table: str, rows: DataFrame | None, gone: DataFrame | None = None) -> dict:
        made = {"rows": None if rows is None else self.write(table, rows), "gone": None, "parts": None, "bytes": 0}
        if made["rows"]:
            at = self._at(made["rows"])
            fs = at.getFileSystem(self._conf)
            made["bytes"] = fs.getContentSummary(at).getLength()
            if table in self.parted:
                made["parts"] = sorted(int(n[5:]) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("part="))
        if gone is not None:
            made["gone"] = f"{table}-gone-snapshot-{uuid.uuid4().hex}"
            gone.select(*self.keys[table]).distinct().write.parquet(f"{self.path}/{made['gone']}")
        return made

    def commit(self, base: int, touched: DataFrame | None = None, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, **tables: DataFrame | None) -> int:
        """Makes a new state from manifest `base`: tables are written whole (None: the table becomes empty), changes (rows, gone keys) are layers on top.

        touched (session): the sessions whose rows change; None: no session's. A commit with whole tables fails if another came first.
        """
        whole = {name: None if rows is None else [self._layer(name, rows)] for name, rows in tables.items()}
        tops = {name: self._layer(name, *c) for name, c in (changes or {}).items()}
        mark = None
        if touched is not None:
            mark = f"touched-snapshot-{uuid.uuid4().hex}"
            touched.select("session").distinct().write.parquet(f"{self.path}/{mark}")
        return self._land(base, whole, tops, mark)

    def _land(self, base: int, whole: dict, tops: dict, mark: str | None) -> int:
        while True:
            before = self._manifest(base)["tables"] if base else {}
            version = base + 1
            after = before | {k: None if v is None else [x | {"seq": version} for x in v] for k, v in whole.items()}
            for name, layer in tops.items():
                after[name] = [*(after.get(name) or []), layer | {"seq": version}]
            try:
                return self._publish(version, {"tables": {k: v for k, v in after.items() if v}, "touched": "*" if whole else mark})
            except Conflict:
                if whole:
                    raise
                now = self.current()[0]
                self._disjoint(base, now, mark)
                base = now

    def _disjoint(self, base: int, now: int, mark: str | None) -> None:
        """Raises a Conflict if a commit after base touched a session of mark, or all."""
        for v in range(base + 1, now + 1):
            theirs = self._manifest(v)["touched"]
            if theirs == "*":
                raise Conflict(f"manifest {v} of {self.path} changed whole tables")
            if theirs and mark:
                mine, other = (self.spark.read.schema("session string").parquet(f"{self.path}/{x}") for x in (mark, theirs))
                if mine.join(other, "session", "left_semi").limit(1).count():
                    raise Conflict(f"manifest {v} of {self.path} changed the same sessions")

    def _publish(self, version: int, manifest: dict) -> int:
        made, final = self._at(f".manifest-{uuid.uuid4().hex}"), self._at(f"manifest-{version:012d}")
        fs = made.getFileSystem(self._conf)
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self._conf).rename(made, final, options)
        except Py4JJavaError as e:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"manifest {version} of {self.path} is taken") from None
            raise
        return version

    # --- upkeep

    def compact(self, schemas: dict[str, str], combine: dict[str, Callable[[DataFrame], DataFrame]] | None = None, least: int = MERGED, whole: bool = False) -> list[str]:
        """Merges the newest layers of each table, where `least` of them are of one size class or smaller; -> the tables. The rows that count stay the same.

        whole: merges all layers of each table that has several, whatever their sizes. combine: what else is done to a table's merged rows. The commit touches no session, so that other writers can go on; one that
        compacts at the same time, or writes a table whole, makes this one fail, which loses nothing.
        """
        base, tables = self.current()
        done = {}
        for name, layers in tables.items():
            n, tier = 0, 0
            for k in range(1, len(layers) + 1):
                size = max(0, layers[-k]["bytes"]).bit_length() // 3  # powers of MERGED
                if size > tier:
                    if n >= least:
                        break
                    tier = size
                n += 1
            if whole:
                n = len(layers)
            if n < max(2, 0 if whole else least):
                continue
            tail, head = layers[-n:], layers[:-n]
            rows = self.read(name, schemas[name], layers=tail, gone=layers)
            gone = [self.spark.read.parquet(f"{self.path}/{x['gone']}") for x in tail if x["gone"]]
            extra = (combine or {}).get(name)
            made = self._layer(name, extra(rows) if extra else rows, reduce(DataFrame.unionByName, gone) if head and gone else None)
            done[name] = [*head, made | {"seq": tail[-1]["seq"]}]
        if done:
            self._publish(base + 1, {"tables": tables | done, "touched": None})
        return sorted(done)

    def vacuum(self, keep: int = 2) -> int:
        """Removes the folders that none of the newest `keep` manifests name, and older manifests; returns how many folders went."""
        names = self._names()
        kept = self._versions(names)[-keep:]
        used = set()
        for v in kept:
            m = self._manifest(v)
            used |= {m["touched"], *(x[k] for layers in m["tables"].values() for x in layers for k in ("rows", "gone"))}
        gone = [n for n in names if "-snapshot-" in n and n not in used]
        old = [f"manifest-{v:012d}" for v in self._versions(names)[:-keep]]
        for n in [*old, *gone]:
            path = self._at(n)
            path.getFileSystem(self._conf).delete(path, True)
        return len(gone)

    def size(self) -> int:
        """Bytes of the current folders."""
        return sum(x["bytes"] for layers in self.current()[1].values() for x in layers)
