"""Bucketed, versioned tables: copy on write, with a manifest that is put in place last.

A table's rows lie in pieces, folders that are written once and never changed.  A manifest names the pieces that
make up a version: for every bucket of the key's hash its own ones, and the fresh pieces that appends have left for
all buckets.  Changing keys rewrites the buckets that hold them and no other; appending writes one
piece.  The next manifest is moved into place when all its pieces are complete, so a job that dies before leaves the
former version as it was, and readers keep the version that they began with.  Two writers can't both put
the same version in place: the second one fails.

`applied` keeps, for each name of a run, the last batch that has been applied, so that a repeated batch is
recognised.  Manifests hold a bounded number of names: buckets times pieces, and one number per run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.sources.files import put_once

BUCKETS = 64
#: Fresh pieces that a reader puts up with before they are folded into the buckets.
FRESH = 32
_BUCKET = "_bucket"


class LostRace(RuntimeError):
    """Another writer has put this version in place."""


@dataclass(frozen=True)
class Manifest:
    """One version of a table."""

    version: int = 0
    buckets: dict[int, list[str]] = field(default_factory=dict)
    fresh: list[str] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)

    def pieces(self) -> set[str]:
        return {p for own in self.buckets.values() for p in own} | set(self.fresh)


class BucketedTable:
    """Rows of `schema` in `buckets` buckets of the hash of `key`, under one folder."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.size = spark, root.rstrip("/"), schema, key, buckets

    # Files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose manifest is in place, oldest first."""
        found = self._system().globStatus(self._path("manifests", "*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or one by number; a table that was never written has an empty version 0."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        if version not in known:
            raise ValueError(f"{self.root} has no version {version}")
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).collect())
        held = json.loads(text)
        return Manifest(version, {int(k): v for k, v in held["buckets"].items()}, held["fresh"], held["applied"])

    def _put(self, manifest: Manifest) -> Manifest:
        """Move a complete manifest into place; a file is never seen half written and never replaced."""
        held = json.dumps({"buckets": manifest.buckets, "fresh": manifest.fresh, "applied": manifest.applied})
        if not put_once(self.spark, f"{self.root}/manifests/{manifest.version:012d}.json", held):
            raise LostRace(f"{self.root} already has version {manifest.version}")
        return manifest

    # Reads

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.size)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that hold the keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, manifest: Manifest | None = None, without: Iterable[str] = ()) -> DataFrame:
        """The rows of some buckets, or of all.  Only their pieces are listed and read; `without` names fresh pieces to leave out."""
        held = self.manifest() if manifest is None else manifest
        wanted = set(range(self.size) if buckets is None else buckets)
        paths = [f"{self.root}/pieces/{p}/{_BUCKET}={b}" for b in sorted(wanted & set(held.buckets)) for p in held.buckets[b]]
        fresh = [f"{self.root}/pieces/{p}" for p in held.fresh if p not in set(without)]
        out = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if fresh:
            new = self.spark.read.schema(self.schema).parquet(*fresh)
            out = out.unionByName(new if buckets is None else new.where(self.bucket_of(F.col(self.key)).isin(sorted(wanted))))
        return out

    # Writes

    def _piece(self, manifest: Manifest) -> str:
        return f"{manifest.version + 1:012d}-{uuid.uuid4().hex[:8]}"

    def _write_buckets(self, rows: DataFrame, piece: str) -> list[int]:
        """Write rows under their buckets; the buckets that got a folder."""
        dealt = rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket_of(F.col(self.key))).hint("rebalance", _BUCKET)
        dealt.write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{self.root}/pieces/{piece}")
        found = self._system().globStatus(self._path("pieces", piece, f"{_BUCKET}=*")) or []
        return [int(f.getPath().getName().split("=")[1]) for f in found]

    def _next(self, manifest: Manifest, batch: tuple[str, int] | None, **changes) -> Manifest:
        applied = {**manifest.applied, **({batch[0]: batch[1]} if batch else {})}
        return replace(manifest, version=manifest.version + 1, applied=applied, **changes)

    def done(self, batch: tuple[str, int] | None, manifest: Manifest | None = None) -> bool:
        """Whether a batch (run, number) has been applied."""
        held = self.manifest() if manifest is None else manifest
        return batch is not None and held.applied.get(batch[0], -1) >= batch[1]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, label: str = "") -> Manifest:
        """Add rows as one fresh piece; many fresh pieces are folded into the buckets first.

        With a label the piece takes the place of fresh ones with the same label.
        """
        held = self.manifest()
        if self.done(batch, held):
            return held
        own = self.labelled(label, held) if label else []
        if len(held.fresh) - len(own) >= FRESH:
            # What is replaced below is not folded.
            held = self.rewrite([], lambda old: old, leave=own)
        piece = self._piece(held) + (f"-{label}" if label else "")
        rows.select(*self.schema.names).write.mode("errorifexists").parquet(f"{self.root}/pieces/{piece}")
        return self._put(self._next(held, batch, fresh=[*(p for p in held.fresh if p not in own), piece]))

    def labelled(self, label: str, manifest: Manifest) -> list[str]:
        """Fresh pieces with this label."""
        return [p for p in manifest.fresh if p.split("-", 2)[2:] == [label]]

    def rewrite(
        self, buckets: Iterable[int], change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, leave: Iterable[str] = ()
    ) -> Manifest:
        """Replace the rows of some buckets by what `change` makes of them.

        `change` must keep rows in their buckets, or bring new ones for these buckets only.  Fresh pieces are folded into
        the buckets that they have rows for in the same step, but for those to `leave`.
        """
        held = self.manifest()
        if self.done(batch, held):
            return held
        wanted, leave = set(buckets), list(leave)
        folded = [p for p in held.fresh if p not in leave]
        if folded:
            wanted |= set(self.touched(self.spark.read.schema(self.schema).parquet(*[f"{self.root}/pieces/{p}" for p in folded])))
        piece = self._piece(held)
        made = self._write_buckets(change(self.read(sorted(wanted), held, leave)), piece) if wanted else []
        stray = set(made) - wanted
        if stray:
            raise ValueError(f"rows for buckets {sorted(stray)}, which are not rewritten")
        left = {b: own for b, own in held.buckets.items() if b not in wanted}
        return self._put(self._next(held, batch, buckets={**left, **{b: [piece] for b in made}}, fresh=leave))

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
        """Drop all rows with one of the keys."""
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self.rewrite(self.touched(gone), lambda old: old.join(gone, self.key, "left_anti"), batch)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete manifests but the newest `keep`, and pieces that none of these names; the versions that went."""
        known = self.versions()
        old, left = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        named = {p for v in left for p in self.manifest(v).pieces()}
        system = self._system()
        for version in old:
            system.delete(self._path("manifests", f"{version:012d}.json"), False)
        newest = left[-1] if left else 0
        for status in system.globStatus(self._path("pieces", "*")) or []:
            name = status.getPath().getName()
            # A piece for a later version may belong to a writer that has not finished.
            if name not in named and int(name.split("-")[0]) <= newest:
                system.delete(status.getPath(), True)
        return old
