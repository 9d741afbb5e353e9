"""Language identification by word, for texts that mix languages.

A word is a run of ASCII letters and of bytes of other scripts. Its script, from
ranges of lead bytes, leaves only the languages whose training words use that
script. For these it has a score from byte trigrams (with the word's borders)
and from the word as a whole, learned as smoothed log frequencies. The most
likely sequence of languages under a fixed penalty for each switch is found with
Viterbi's algorithm, and runs of words of one language are the spans. A text's
language is the one with the most letters' bytes in its spans; the score is that
language's share, times how sure the words are of it.

Defined cases: a null text, or one without a letter, has language ``und``, score
0 and no spans. Training rows with null text or language are left out; without
any training rows all texts are ``und``. Of equally likely languages the first by
name is taken. A text of any length is read whole, in one task. Repeated rows count
repeatedly, and are each labelled. An empty table gives no rows. Columns of the
input that have the name of an output column are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import words as W
from kindred.llm.exprs import named, packed, unpacked

#: Most rows that a model is trained on; of more rows, those of the lowest hash are taken.
TRAIN_ROWS = 20_000
SWITCH_PENALTY = 6.0
FLOOR = -6.0
BUCKETS = 1 << 16
WORD_WEIGHT = 0.5
LEAST_SCRIPT_SHARE = 0.005

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

#: Scripts by the first byte of a character: fixed ranges of UTF-8.
SCRIPTS = [
    ("latin", [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]),
    ("greek", [0xCD, 0xCE, 0xCF]),
    ("cyrillic", [0xD0, 0xD1, 0xD2, 0xD3]),
    ("armenian_hebrew", [0xD4, 0xD5, 0xD6, 0xD7]),
    ("arabic", [0xD8, 0xD9, 0xDA, 0xDB]),
    ("brahmic", [0xE0]),
    ("georgian_other", [0xE1]),
    ("kana_han", [0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9]),
    ("hangul", [0xEA, 0xEB, 0xEC, 0xED]),
]
SCRIPT_OF = np.zeros(256, dtype=np.int8)
for _k, (_, _bytes) in enumerate(SCRIPTS):
    SCRIPT_OF[_bytes] = _k + 1
N_SCRIPTS = len(SCRIPTS) + 1

COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])


def trigram_keys(buf: np.ndarray) -> np.ndarray:
    """A bucket for the trigram in the middle of which each byte is; ``buf`` has 0 for all but letters."""
    b = buf.astype(np.uint64)
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    key = (before << np.uint64(16)) | (b << np.uint64(8)) | after
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


@dataclass
class Features:
    words: W.Words
    trigrams: np.ndarray
    whole: np.ndarray
    script: np.ndarray


def features(raw: np.ndarray, offsets: np.ndarray) -> Features:
    low = W.LOWER[raw]
    # a gap after each text, so that trigrams do not reach over its border
    words = W.find_words(low, offsets, LETTERS)
    clean = np.where(LETTERS[low], low, 0).astype(np.uint8)
    keys = trigram_keys(clean)
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    for at, cut_before in ((edge, True), (edge - 1, False)):
        if len(at):
            b = clean.astype(np.uint64)
            prev = np.zeros(len(at), dtype=np.uint64) if cut_before else np.where(at > 0, b[np.maximum(at - 1, 0)], 0)
            nxt = np.where(at + 1 < len(b), b[np.minimum(at + 1, len(b) - 1)], 0) if cut_before else np.zeros(len(at), dtype=np.uint64)
            key = (prev.astype(np.uint64) << np.uint64(16)) | (b[at] << np.uint64(8)) | nxt.astype(np.uint64)
            keys[at] = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    whole = (words.hashes() >> np.uint64(48)).astype(np.int64)
    script = np.maximum.reduceat(SCRIPT_OF[raw], words.starts) if len(words.starts) else np.empty(0, dtype=np.int8)
    return Features(words, keys, whole, script)


class _Count:
    """Counts of trigrams, whole words and scripts of each language; k says which."""

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "__text"):
                f = features(raw, offsets)
                byte_doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                word_doc = np.repeat(np.arange(part.num_rows), np.diff(f.words.first))
                names = part.column("lang").to_pylist()
                of = np.array([hash(n) for n in names])
                inside = LETTERS[raw]
                for lang in sorted(set(names)):
                    mine = of == hash(lang)
                    t = total.setdefault(lang, np.zeros(2 * BUCKETS + N_SCRIPTS, dtype=np.int64))
                    t[:BUCKETS] += np.bincount(f.trigrams[inside & mine[byte_doc]], minlength=BUCKETS)
                    own = mine[word_doc]
                    t[BUCKETS : 2 * BUCKETS] += np.bincount(f.whole[own], minlength=BUCKETS)
                    t[2 * BUCKETS :] += np.bincount(f.script[own], minlength=N_SCRIPTS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=COUNTS.names)


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray
    whole: np.ndarray
    allowed: np.ndarray


def train(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``text`` and ``lang``; rows beyond ``max_rows`` are sampled by hash of doc_id."""
    rows = docs.where("text is not null and lang is not null").select(F.col("lang"), F.col("text").cast("binary").alias("__text"), F.xxhash64("doc_id").alias("__h"))
    n = docs.where("lang is not null").select("lang").count()
    if n > max_rows:
        rows = rows.where(F.pmod("__h", F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    counts = rows.select("lang", "__text").mapInArrow(_Count(), COUNTS).groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counts.column("lang").to_pylist(), dtype=object)
    k, n = counts.column("k").to_numpy(), counts.column("n").to_numpy()
    names = sorted(set(langs.tolist()))
    table = np.zeros((2 * BUCKETS + N_SCRIPTS, max(1, len(names))))
    for i, name in enumerate(names):
        mine = langs == name
        table[k[mine], i] = n[mine]

    def logs(t: np.ndarray, smooth: float) -> np.ndarray:
        used = max(1, int((t.sum(1) > 0).sum()))
        return np.log((t + smooth) / (t.sum(0) + smooth * used)).astype(np.float32)

    script = table[2 * BUCKETS :]
    allowed = script / np.maximum(script.sum(0), 1) >= LEAST_SCRIPT_SHARE
    allowed[~allowed.any(1)] = True
    return Model(names, logs(table[:BUCKETS], 0.5), logs(table[BUCKETS : 2 * BUCKETS], 0.5), allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; ``first`` has the bounds of the texts.

    Texts advance together, longest first, so each step is one operation for all
    texts that are that long.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(scores):
        return labels
    kind = np.min_scalar_type(scores.shape[1])
    back = np.zeros(scores.shape, dtype=kind)
    own = np.arange(scores.shape[1], dtype=kind)
    alive = np.searchsorted(-n, -np.arange(n[0] + 1), side="left")  # texts of more than t words
    v = scores[at[: alive[0]]].astype(np.float64)
    ends: list[tuple[int, int, np.ndarray]] = []
    for t in range(1, int(n[0])):
        m = int(alive[t])
        if m < len(v):
            ends.append((m, len(v), v[m:].argmax(1)))
            v = v[:m]
        best = v.argmax(1)
        jump = v[np.arange(m), best] - penalty
        move = jump[:, None] > v
        rows = at[:m] + t
        back[rows] = np.where(move, best[:, None].astype(kind), own)
        v = np.where(move, jump[:, None], v) + scores[rows]
    ends.append((0, len(v), v.argmax(1)))
    now = np.zeros(int(alive[0]), dtype=np.int64)
    for lo, hi, last in ends:
        now[lo:hi] = last
    for t in range(int(n[0]) - 1, -1, -1):
        m = int(alive[t])
        rows = at[:m] + t
        labels[rows] = now[:m]
        now[:m] = back[rows, now[:m]]
    return labels


class _Label:
    def __init__(self, model: Model, penalty: float, names: list[str]):
        self.model, self.penalty, self.names = model, penalty, names

    def scores(self, f: Features) -> np.ndarray:
        m = self.model
        at, size = f.words.starts, f.words.ends - f.words.starts
        s = np.empty((len(at), len(m.languages)), dtype=np.float32)
        for k in range(len(m.languages)):
            s[:, k] = np.add.reduceat(m.trigrams[:, k][f.trigrams], at) if len(at) else 0
        # reduceat also sums what lies between words: buckets of bytes that are no letters
        s -= self._between(f, at)
        s += WORD_WEIGHT * m.whole[f.whole]
        allowed = m.allowed[f.script.astype(np.int64)]
        s = np.where(allowed, s, -1e6)
        del size
        return np.maximum(s - s.max(1, keepdims=True), np.where(allowed, FLOOR, 4 * FLOOR)).astype(np.float32)

    def _between(self, f: Features, at: np.ndarray) -> np.ndarray | float:
        """What ``reduceat`` took from behind each word's end."""
        if not len(at):
            return 0.0
        outside = np.ones(len(f.trigrams), dtype=bool)
        outside[np.repeat(at, f.words.ends - at) + np.arange((f.words.ends - at).sum()) - np.repeat(np.cumsum(f.words.ends - at) - (f.words.ends - at), f.words.ends - at)] = False
        where = np.flatnonzero(outside)
        word = np.searchsorted(at, where, side="right") - 1
        where, word = where[word >= 0], word[word >= 0]
        out = np.zeros((len(at), len(self.model.languages)), dtype=np.float32)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(word, self.model.trigrams[:, k][f.trigrams[where]], minlength=len(at))
        return out

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(self.model.languages)
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "text", 1 << 20):
                f = features(raw, offsets)
                first = f.words.first
                lettered = self._lettered(raw, offsets, f)
                preds, sure, spans = [], [], []
                if n_lang and len(f.words.starts):
                    s = self.scores(f)
                    labels = viterbi(s, first, self.penalty)
                    size = (f.words.ends - f.words.starts).astype(np.float64)
                    doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                    mass = np.bincount(doc * n_lang + labels, size, minlength=part.num_rows * n_lang).reshape(-1, n_lang)
                    fit = np.bincount(doc, size * np.exp(np.clip(s[np.arange(len(s)), labels], -1, 0)), minlength=part.num_rows)
                    total = np.maximum(mass.sum(1), 1)
                    best = mass.argmax(1)
                    share = mass[np.arange(len(mass)), best] / total * (fit / total)
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    change = np.ones(len(labels), dtype=bool)
                    change[1:] = labels[1:] != labels[:-1]
                    change[first[:-1][first[:-1] < len(labels)]] = True
                    heads = np.flatnonzero(change)
                    tails = np.append(heads[1:], len(labels)) - 1
                    head_doc = doc[heads]
                    zero = points[offsets[:-1]][head_doc]
                    begin, end = points[f.words.starts[heads]] - zero, points[f.words.ends[tails]] - zero
                    cut = np.searchsorted(head_doc, np.arange(part.num_rows + 1))
                    names = self.model.languages
                for d in range(part.num_rows):
                    if not lettered[d] or not n_lang or first[d] == first[d + 1]:
                        preds.append("und")
                        sure.append(0.0)
                        spans.append([])
                    else:
                        preds.append(names[best[d]])
                        sure.append(float(min(1.0, share[d])))
                        spans.append([{"start": int(begin[i]), "end": int(end[i]), "lang": names[labels[heads[i]]]} for i in range(cut[d], cut[d + 1])])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                new = {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(sure, pa.float64()), "spans": pa.array(spans, span)}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in self.names], names=self.names)

    @staticmethod
    def _lettered(raw: np.ndarray, offsets: np.ndarray, f: Features) -> list[bool]:
        """Whether each text has a letter. Only texts without an ASCII letter are looked at closely."""
        plain = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(LETTERS[raw] & (raw < 0x80), out=plain[1:])
        has = (plain[offsets[1:]] > plain[offsets[:-1]]).tolist()
        for d, ok in enumerate(has):
            if not ok and f.words.first[d + 1] > f.words.first[d]:
                has[d] = any(map(str.isalpha, raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")))
        return has


def label_languages(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score and spans (start, end in code points, and language)."""
    now = packed(docs, ("text",), text=F.col("text"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
    schema = T.StructType([*now.schema, *added])
    out = now.mapInArrow(_Label(model, penalty, schema.names), schema)
    return unpacked(out, docs.columns, {n: F.col(n) for n in ("text", "lang_pred", "score", "spans")})


def held_out() -> F.Column:
    """Rows that no model is trained on: crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows that have a language, with the columns of ``docs``; all rows where no language could be learned."""
    model = train(docs.where(~held_out()))
    if not model.languages:
        return docs
    return label_languages(docs, model).where("lang_pred <> 'und'").select(*named(docs.columns))
