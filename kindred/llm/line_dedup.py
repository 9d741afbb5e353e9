"""Line deduplication with levelled sorted runs of line hashes.

Documents are hashed line by line into entries (hash of the line's key,
document). Entries come in ``BATCHES`` batches of about as many documents, largest
ids first, however many rows there are. A run is a table, bucketed and sorted by
hash, with a row a key: in how many documents the key is, and its keeper. A new
batch is merge-anti-joined with all runs: a key that no run has is new, and the
batch's largest document id becomes its keeper; for keys that a run has, the
batch only adds to the number of holders and never a keeper, so the first batch
that has a line decides, and in falling order of ids that is the largest id. The
batch's rows become a run of level 0. When a level has ``fan_in`` runs, they are
compacted into one of the next level, so that a key is rewritten once a level.
All runs of a store have the same buckets, so a batch is shuffled once and the
runs are not when they are joined.

A store outlives its session: ``LineRuns.open`` finds its runs by a manifest,
written anew after each batch, and a later ``dedup_lines`` with that store treats
its documents as the next batches.

At the end, keys with enough holders are joined with the entries. Keys with more
than one in 4096 of all entries, of which there are 4096 at most, are broadcast;
the others are joined by shuffle. What is left is a list of line numbers to drop
for each document.

Defined cases: null and empty text is one empty line and its kept text is empty.
Each row is a document: rows that share an id count one by one as holders of a
line, and if theirs is the largest id they all keep it. A null id counts as
smaller than all others. Lines of a key shorter than ``min_chars`` code points
always stay. A text of any length is split whole; one text must fit in a task. An
empty table gives no rows. Other columns, whatever their names, pass through;
columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import words as W
from kindred.llm.exprs import named
from kindred.llm.scratch import Scratch, hadoop_path, join_split

BLANK = b" \t\n\x0b\x0c\r"
BATCHES = 4
FAN_IN = 3

ENTRY = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("h", T.BinaryType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Hash of each long enough key, and the numbers of its lines."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
    return out


class _Entries:
    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "text"):
                low, at = raw.tobytes(), offsets.tolist()
                rows, hashes, lines = [], [], []
                for d in range(part.num_rows):
                    found = line_keys(low[at[d] : at[d + 1]], self.min_chars)
                    rows += [d] * len(found)
                    hashes += found.keys()
                    lines += found.values()
                of = part.select(["doc_id", "text_hash", "batch"]).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(hashes, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=ENTRY.names)


class _Keep:
    """Removes the numbered lines."""

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "text"):
                low, at = raw.tobytes(), offsets.tolist()
                total, gone, kept = [], [], []
                for d, drop in enumerate(part.column("drop").to_pylist()):
                    text = low[at[d] : at[d + 1]]
                    total.append(text.count(b"\n") + 1)
                    out = set(drop or ())
                    if out:
                        text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in out])
                    gone.append(len(out))
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_lines", "n_dropped"])


class LineRuns:
    """A store of levelled runs (h, n, keeper) in the folder ``root``.

    A key has one row with a keeper over all runs; in its other rows the keeper
    is null, and they only add holders. ``buckets`` is fixed for the life of the
    store: the session's shuffle partitions when it was made.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.root, self.fan_in = spark, root, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = self.batches = self.compactions = 0
        self._names: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineRuns:
        """The store as its last complete manifest has it."""
        fs, path = hadoop_path(spark, f"{root}/manifest")
        last = max((f.getPath().toString() for f in fs.listStatus(path) if not f.getPath().getName().startswith("_")), default=None)
        if last is None:
            raise FileNotFoundError(f"no manifest in {root}")
        m = json.loads(spark.read.text(last).first()[0])
        store = cls(spark, root, m["buckets"], m["fan_in"])
        store.levels, store.version, store.batches, store.compactions = m["levels"], m["version"], m["batches"], m["compactions"]
        return store

    def _commit(self, *unused: str) -> None:
        """Writes the manifest, and then deletes what it no longer names."""
        old = f"{self.root}/manifest/{self.version:09d}"
        self.version += 1
        state = {"buckets": self.buckets, "fan_in": self.fan_in, "levels": self.levels, "version": self.version, "batches": self.batches, "compactions": self.compactions}
        fs, new = hadoop_path(self.spark, f"{self.root}/manifest/_{self.version:09d}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.rename(new, hadoop_path(self.spark, f"{self.root}/manifest/{self.version:09d}")[1])
        for path in (old, *unused):
            fs, p = hadoop_path(self.spark, path if "/" in path else f"{self.root}/{path}")
            fs.delete(p, True)
            if path in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(path)}")

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table, which the session's catalogue may not know yet."""
        if run not in self._names:
            name = f"kindred_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BINARY, n BIGINT, keeper BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")
            self._names[run] = name
        return self.spark.table(self._names[run])

    def all(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame, level: int) -> str:
        run, name = f"run-{level}-{uuid.uuid4().hex}", f"kindred_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{run}").saveAsTable(name)
        self._names[run] = name
        return run

    def _merged(self, runs: list[str]) -> DataFrame:
        # Read as plain tables: Spark 4.1 takes a union of bucketed scans for partitioned by key, and then reads it otherwise.
        paths = [f"{self.root}/{r}" for r in runs]
        return self.spark.read.schema("h binary, n bigint, keeper bigint").parquet(*paths).groupBy("h").agg(F.sum("n").alias("n"), F.first("keeper", ignorenulls=True).alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: h, n (documents of the batch that hold it), top (largest id). Keys that no run has get ``top`` as keeper."""
        rows = batch.select("h", "n", F.col("top").alias("keeper"))
        # Each merge with a run is the anti-join (keys that stay new) and its complement (keys that only gain holders) in one.
        for r in self.all():
            known = self._table(r).where("keeper is not null").select("h", F.lit(True).alias("known")).hint("merge")
            rows = rows.join(known, "h", "left").select("h", "n", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self.batches += 1
        self._put(0, self._write(rows, 0))

    def _put(self, level: int, run: str) -> None:
        old: list[str] = []
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                break
            full, self.levels[level] = self.levels[level], []
            run, level = self._write(self._merged(full), level + 1), level + 1
            self.compactions += 1
            old += full
        self._commit(*old)

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(runs := self.all()) > 1:
            level = len(self.levels) - 1
            run = self._write(self._merged(runs), level)
            self.levels = [[] for _ in range(level)] + [[run]]
            self.compactions += 1
            self._commit(*runs)

    def holders(self) -> DataFrame:
        """h, n and keeper of all keys."""
        return self._merged(self.all())


def _batch_of(docs: DataFrame, batches: int) -> F.Column:
    """0 for the largest ids, and so on; null ids come last."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    n = F.lit(0)
    for c in sorted(set(cuts or [])):
        n = n + F.coalesce((F.col("doc_id") <= c).cast("int"), F.lit(1))
    return n


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, fan_in: int = FAN_IN, store: LineRuns | None = None) -> DataFrame:
    """``docs`` with kept text in ``text``, and n_lines and n_dropped.

    With a ``store``, lines that earlier batches hold count, and keep their keeper there.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    text = F.col("text").cast("binary")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _batch_of(docs, batches).alias("batch"), text.alias("text"))
    entries = scratch.save(found.mapInArrow(_Entries(min_chars), ENTRY), "entries", partition_by="batch")
    numbers = sorted(r["batch"] for r in entries.select("batch").distinct().collect())
    own = store is None
    store = store or LineRuns(spark, scratch.path("runs"), fan_in=fan_in)
    for k in numbers:
        store.add(_holders(entries.where(F.col("batch") == k)))
    if store.all():
        hot = scratch.save(store.holders().where(F.col("n") >= min_docs), "hot")
        lost = join_split(entries, hot, "h", F.col("n"), entries.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    else:
        lost = entries
    lost = lost.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drop"))
    lost = scratch.save(lost.select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "drop"), "lost")
    scratch.drop(entries)
    if own:
        for r in store.all():
            fs, p = hadoop_path(spark, f"{store.root}/{r}")
            fs.delete(p, True)
            spark.sql(f"DROP TABLE IF EXISTS {store._names[r]}")
    names = [n for n in docs.columns if n not in ("text", "n_lines", "n_dropped")]
    mine = docs.select(F.struct(*named(names)).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64("text").alias("text_hash"))
    joined = mine.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left").select("row", "text", "drop")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    kept = joined.mapInArrow(_Keep(), schema)
    of = {"text": F.col("text").cast("string").alias("text")}
    return kept.select(*(of.get(n, F.col("row").getField(n).alias(n)) for n in docs.columns if n not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


def _holders(batch: DataFrame) -> DataFrame:
    """h, n, top. Summed before the shuffle, so a line in a third of all documents is a row a task."""
    return batch.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
