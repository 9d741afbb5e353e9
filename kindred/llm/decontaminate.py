"""Benchmark decontamination by Wu-Manber search over words.

A window is ``window`` consecutive words of a benchmark item (the whole item if
it has fewer words). Windows of one length m form a searcher: blocks of B words
index a table of shifts, so that a cursor at a block that ends in no window
jumps over up to m - B + 1 words; where the shift is 0 the block, which is the
windows' suffix, selects a bucket of windows, and these are compared directly,
hashes of all words first and then the words themselves.

Defined cases: a null or empty text has no words and no hits. An item whose
text has no words has no windows. An item with a null id counts and is named
by the empty string; items that share an id count once. Rows that repeat are
each judged. A text of any length is searched whole, in one task. Input columns
that have the name of an output column are replaced, all others pass through. An
empty benchmark marks nothing, and an empty table gives no rows.

Benchmark texts are compiled into searchers of at most ``pass_bytes`` each and
shipped with the tasks, without a shuffle. A larger benchmark takes several passes
over the rows; what a pass has found is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import words as W
from kindred.llm.exprs import named, packed, unpacked
from kindred.llm.scratch import Scratch

WINDOW = 10
PASS_BYTES = 16 << 20
SHIFT_BITS = 20


class Searcher:
    """All windows of m words, found by block shifts."""

    def __init__(self, windows: dict[bytes, list[int]], hashes: dict[bytes, np.ndarray], m: int):
        self.m, self.block = m, min(2, m)
        self.texts = sorted(windows)
        self.items = [windows[t] for t in self.texts]
        self.rows = np.array([hashes[t] for t in self.texts], dtype=np.uint64).reshape(-1, m)
        most = m - self.block + 1
        # About eight entries of the table for each block of a window.
        bits = min(SHIFT_BITS, max(10, (8 * most * len(self.texts)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, most, dtype=np.min_scalar_type(-most))
        for j in range(most):
            keys = self._keys(self.rows, np.full(len(self.rows), j + self.block - 1))
            np.minimum.at(self.shift, keys, most - 1 - j)
        suffix = self._keys(self.rows, np.full(len(self.rows), m - 1))
        self.order = np.argsort(suffix, kind="stable")
        self.buckets = suffix[self.order]

    def _keys(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Table index of the block that ends at word ``at`` of each row, or of the one row."""
        if rows.ndim == 2:
            k = np.arange(len(rows))
            parts = [rows[k, at - i] for i in range(self.block)]
        else:
            parts = [rows[at - i] for i in range(self.block)]
        total = parts[0]
        for p in parts[1:]:
            total = total + W.mix(p)
        return (W.mix(total, self.block) & self.mask).astype(np.int64)

    def find(self, w: np.ndarray, first: np.ndarray, text: Callable[[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and of the window, of each occurrence.

        One cursor a text; all move on together, each by its own shift.
        """
        cursor = first[:-1] + self.m - 1
        stop = first[1:]
        starts, found = [], []
        live = cursor < stop
        cursor, stop = cursor[live], stop[live]
        while len(cursor):
            keys = self._keys(w, cursor)
            jump = self.shift[keys]
            if (at := cursor[jump == 0]).size:
                key = keys[jump == 0]
                lo, hi = np.searchsorted(self.buckets, key, "left"), np.searchsorted(self.buckets, key, "right")
                size = hi - lo
                head = np.repeat(at - self.m + 1, size)
                which = self.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
                for i in range(self.m):
                    same = w[head + i] == self.rows[which, i]
                    head, which = head[same], which[same]
                for s, k in zip(head.tolist(), which.tolist(), strict=True):
                    if text(s, s + self.m) == self.texts[k]:
                        starts.append(s)
                        found.append(k)
            cursor = cursor + np.maximum(jump, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        return np.array(starts, dtype=np.int64), np.array(found, dtype=np.int64)


def _split(text: bytes | None) -> list[bytes]:
    buf = W.LOWER[np.frombuffer(text or b"", dtype=np.uint8)]
    words = W.find_words(buf, np.array([0, len(buf)]), W.ALNUM)
    low = buf.tobytes()
    return [low[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def compile_windows(items: list[tuple[str, bytes | None]], window: int) -> tuple[list[Searcher], list[str]]:
    """Searchers of the windows of (id, text) items, and the ids that they refer to."""
    names = sorted({i for i, _ in items})
    index = {n: k for k, n in enumerate(names)}
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for name, text in items:
        words = _split(text)
        m = min(window, len(words))
        for j in range(len(words) - m + 1 if m else 0):
            of = by_length.setdefault(m, {}).setdefault(b" ".join(words[j : j + m]), [])
            if index[name] not in of:
                of.append(index[name])
    out = []
    for m, windows in sorted(by_length.items()):
        hashes = {}
        for t in windows:
            buf = np.frombuffer(t, dtype=np.uint8)
            hashes[t] = W.find_words(buf, np.array([0, len(buf)]), W.ALNUM).hashes()
        out.append(Searcher(windows, hashes, m))
    return out, names


def scan(batches: Iterator[pa.RecordBatch], searchers: list[Searcher], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds to the lists of hit word ranges and of items what these searchers find."""
    for batch in batches:
        for part, raw, offsets in W.chunks(batch, "text"):
            buf = W.LOWER[raw]
            words = W.find_words(buf, offsets, W.ALNUM)
            w, low = words.hashes(), buf.tobytes()
            starts, ends, n = words.starts, words.ends, part.num_rows

            def text(i: int, j: int) -> bytes:
                return b" ".join([low[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)])  # noqa: B023

            ranges: list[list[int]] = [list(x) for x in part.column("ranges").to_pylist()]
            items: list[set[str]] = [set(x) for x in part.column("items").to_pylist()]
            for s in searchers:
                at, which = s.find(w, words.first, text)
                order = np.argsort(at, kind="stable")
                doc = np.searchsorted(words.first, at, side="right") - 1
                for k in order.tolist():
                    d, begin = int(doc[k]), int(at[k] - words.first[doc[k]])
                    r = ranges[d]
                    if r and r[-2] <= begin <= r[-1]:
                        r[-1] = max(r[-1], begin + s.m)
                    else:
                        r += (begin, begin + s.m)
                    items[d].update(names[i] for i in s.items[which[k]])
            new = {
                "n": pa.array(np.diff(words.first), pa.int64()),
                "ranges": pa.array(ranges, pa.list_(pa.int64())),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            assert n == len(ranges)
            yield pa.RecordBatch.from_arrays([new.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], schema=schema)


def covered(ranges: list[int]) -> int:
    """Words in the union of [begin, end) ranges, given as a flat list."""
    total = last = 0
    for b, e in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        total += max(0, e - max(b, last))
        last = max(last, e)
    return total


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // pass_bytes))
    now = packed(docs, ("text",), text=F.col("text"), n=F.lit(0).cast("long"), ranges=F.array().cast("array<bigint>"), items=F.array().cast("array<string>"))
    scratch, before = Scratch(docs.sparkSession, "decontaminate"), None
    for k in range(passes):
        rows = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).collect()
        searchers, names = compile_windows([(r.id, bytes(r.text) if r.text is not None else None) for r in rows], window)
        now = now.mapInArrow(_Scan(searchers, names), now.schema)
        if k < passes - 1:  # so that a task never holds the searchers of two passes
            now = scratch.save(now, "pass")
            if before is not None:
                scratch.drop(before)
            before = now
    hit = F.aggregate(
        F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2).cast("int") - 1), lambda i: F.struct(F.get("ranges", 2 * i).alias("b"), F.get("ranges", 2 * i + 1).alias("e")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last")),
        lambda a, r: F.struct((a.n + F.greatest(F.lit(0).cast("long"), r.e - F.greatest(r.b, a["last"]))).alias("n"), F.greatest(a["last"], r.e).alias("last")),
        lambda a: a.n,
    )
    now = now.withColumn("hit", F.when(F.size("ranges") > 0, hit).otherwise(F.lit(0).cast("long")))
    return unpacked(now, docs.columns, {"text": F.col("text"), "n_words": F.col("n"), "n_hit": F.col("hit"), "n_items": F.size("items").cast("long"), "item_ids": F.array_sort("items"), "contaminated": F.col("hit") > 0})


class _Scan:
    def __init__(self, searchers: list[Searcher], names: list[str]):
        self.searchers, self.names = searchers, names

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from scan(iter([batch]), self.searchers, self.names, batch.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns of ``docs``."""
    return find_contamination(docs, benchmark, window).where("not contaminated").select(*named(docs.columns))
