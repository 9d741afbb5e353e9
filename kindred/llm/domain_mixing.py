"""Mixing documents to target weights by soft membership of domains.

A softmax classifier on hashed words and a few text measures is fitted to the
labelled table and gives each document posteriors over the domains. Document
rates are then the least-squares solution, with rates of 0 or more, of

    sum_k (sum_d rate_d tokens_d p_dk - target_k)^2

that lies nearest to rate 1, each document weighing as its tokens. It has the form
rate_d = max(0, 1 - p_d . w) with one number w_k for each domain, the residual of
the domain over a small ``SOFTNESS``; w maximises a concave function of K numbers,
which Newton steps with halved lengths find. A step is one aggregation over a table
of (tokens, posteriors) without texts; only sums of size K * K go to the driver. It
ends when the conditions hold to ``TOLERANCE`` of the budget, and raises after
``STEPS``. Where no rates reach the targets the nearest totals are taken, and a
warning tells what is left. A document's rate follows from its posteriors and w,
so the last pass works it out next to the text and nothing has to be joined.

Defined cases: a null or empty text has no tokens, the posteriors of an empty
text and no influence; a text of any length is read whole, in one task. Equal texts
have equal posteriors and rates; copies differ by the hash of the id. Documents that
share an id are mixed one by one. Labels
with nulls, and labels of unknown documents, are not learned from. Without any
labels there is one domain, ``all``. Targets of domains that no label has are
ignored, and the remaining ones are scaled to sum to 1. An empty table gives no
rows. Only the columns in ``keep`` are returned; of these, ones that have the name
of an output column are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm import words as W
from kindred.llm.scratch import Scratch

#: Most labelled rows that the classifier is fitted on, by hash of the id.
TRAIN_ROWS = 3000
BUCKETS = 1 << 15
EPOCHS = 60
STEPS = 200
TOLERANCE = 1e-4
#: As a share of the tokens.
SOFTNESS = 1e-7
#: Lengths of a step that are tried in one pass.
LENGTHS = [2.0**-i for i in range(12)]

#: Production weights of the domains quality_toxic.
TARGETS = {"1_0": 0.80, "0_0": 0.17, "1_1": 0.02, "0_1": 0.01}
_MEASURES = 24


def feature_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct hashed features of each text, and its number of words."""
    low = W.LOWER[raw]
    words = W.find_words(low, offsets, W.ALNUM)
    spaced = W.find_words(low, offsets, W.NOT_SPACE)
    n = np.diff(spaced.first)
    ids = (words.hashes() % np.uint64(BUCKETS)).astype(np.int32)
    symbols = np.zeros(len(raw) + 1, dtype=np.int64)
    marks = np.zeros(256, dtype=bool)
    marks[[ord(c) for c in "#*$%&|<>!"]] = True
    np.cumsum(marks[raw], out=symbols[1:])
    size = np.maximum(np.diff(offsets), 1)
    share = (symbols[offsets[1:]] - symbols[offsets[:-1]]) / size
    out = []
    first = words.first.tolist()
    for d in range(len(n)):
        own = ids[first[d] : first[d + 1]]
        distinct = np.unique(own)
        measures = [min(7, int(share[d] * 40)), 8 + min(7, int(8 * len(distinct) / max(1, len(own)))), 16 + min(7, int(np.log2(n[d] + 1) / 2))]
        out.append(np.concatenate([distinct, BUCKETS + np.array(measures, dtype=np.int32)]))
    return out, n


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray

    def posteriors(self, ids: list[np.ndarray]) -> np.ndarray:
        if not ids:
            return np.empty((0, len(self.domains)))
        flat = np.concatenate(ids)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
        scale = 1 / np.sqrt(np.array([len(x) for x in ids]))
        logits = np.add.reduceat(self.weights[flat], bounds, axis=0) * scale[:, None]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def fit(ids: list[np.ndarray], labels: list[str], epochs: int = EPOCHS) -> Classifier:
    domains = sorted(set(labels))
    model = Classifier(domains or ["all"], np.zeros((BUCKETS + _MEASURES, max(1, len(domains)))))
    if len(domains) < 2:
        return model
    truth = np.eye(len(domains))[[domains.index(x) for x in labels]]
    flat, size = np.concatenate(ids), np.array([len(x) for x in ids])
    of, scale = np.repeat(np.arange(len(ids)), size), 1 / np.sqrt(size)
    squares = np.full_like(model.weights, 1e-8)
    for _ in range(epochs):
        error = (model.posteriors(ids) - truth) * scale[:, None]
        for k in range(len(domains)):
            g = np.bincount(flat, error[of, k], minlength=len(model.weights)) + 1e-4 * model.weights[:, k]
            squares[:, k] += g * g
            model.weights[:, k] -= 0.5 * g / np.sqrt(squares[:, k])
    return model


class _Features:
    """doc_id, domain and features of labelled rows."""

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "__text"):
                ids, _ = feature_ids(raw, offsets)
                yield pa.RecordBatch.from_arrays([part.column("domain"), pa.array([x.tobytes() for x in ids], pa.binary())], names=["domain", "ids"])


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), max_rows: int = TRAIN_ROWS) -> Classifier:
    named = labels.select("doc_id", F.concat_ws("_", *columns).alias("domain"), *columns).dropna().select("doc_id", "domain")
    total = named.count()
    if total > max_rows:
        named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("__text")).where("__text is not null").join(named, "doc_id")
    table = rows.select("domain", "__text").mapInArrow(_Features(), "domain string, ids binary").toArrow()
    ids = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in table.column("ids").combine_chunks()] if table.num_rows else []
    return fit(ids, table.column("domain").to_pylist())


def _wanted(p: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors over the domains that are not barred, 0 for documents more likely of barred ones, and these documents."""
    gone = p[:, barred].sum(1) > 0.5
    if not barred.any():
        return p, gone
    left = np.where(barred | gone[:, None], 0.0, p)
    return left / np.where(gone, 1.0, left.sum(1))[:, None], gone


class _Posteriors:
    def __init__(self, model: Classifier, names: list[str], barred: np.ndarray, slopes: np.ndarray | None = None, least: float = 0.0):
        self.model, self.names, self.barred, self.slopes, self.least = model, names, barred, slopes, least

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in W.chunks(batch, "text"):
                ids, n = feature_ids(raw, offsets)
                p = self.model.posteriors(ids)
                wanted, gone = _wanted(p, self.barred)
                if self.slopes is None:
                    p, rate = wanted, np.ones(len(n))
                else:
                    rate = np.where(gone, 0.0, np.maximum(self.least, 1 - wanted @ self.slopes))
                new = {"n_tokens": pa.array(n.astype(np.int64)), "posteriors": pa.array(list(p), pa.list_(pa.float64())), "rate": pa.array(rate)}
                yield pa.RecordBatch.from_arrays([new[x] if x in new else part.column(x) for x in self.names], names=self.names)


class _Sums:
    """For each w: tokens * rate^2, the tokens of each domain, and their change by each w_k, in one list."""

    def __init__(self, tries: list[np.ndarray]):
        self.tries = tries

    @W.lean
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p = batch.column("posteriors").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
                part = []
                for w in self.tries:
                    rate = np.maximum(0.0, 1 - p @ w)
                    part += [[n @ rate**2], p.T @ (n * rate), (p.T @ (p * (n * (rate > 0))[:, None])).ravel()]
                part = np.concatenate(part)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "total"])


def domain_totals(table: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain at rate 1."""
    out = np.zeros(k)
    for r in table.select(F.posexplode("posteriors").alias("k", "p"), "n_tokens").groupBy("k").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("m")).collect():
        out[r["k"]] = r["m"]
    return out


def solve_rates(table: DataFrame, targets: np.ndarray, max_steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """w of the rates of ``table`` (n_tokens, posteriors), and the residuals of its domains."""
    k = len(targets)
    soft = SOFTNESS * max(domain_totals(table, k).sum(), 1.0)
    allowed = TOLERANCE * (targets.sum() or 1.0)

    def sums(tries: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        flat = np.zeros((len(tries), 1 + k + k * k))
        for r in table.mapInArrow(_Sums(tries), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect():
            flat.flat[r["k"]] = r["total"]
        # The function to minimise, the tokens of each domain, and the sum of tokens * p * p.
        return [(x[0] / 2 + w @ targets + soft * (w @ w) / 2, x[1 : k + 1], x[k + 1 :].reshape(k, k)) for w, x in zip(tries, flat)]

    w = np.zeros(k)
    _, got, curve = sums([w])[0]
    for _ in range(max_steps):
        error = got - targets - soft * w
        if np.abs(error).sum() <= allowed:
            break
        step = np.linalg.solve(curve + soft * np.eye(k), error)
        tries = [w + x * step for x in LENGTHS]
        found = sums(tries)
        best = min(range(len(tries)), key=lambda i: found[i][0])
        w, (_, got, curve) = tries[best], found[best]
    else:
        raise RuntimeError(f"rates did not settle in {max_steps} steps; left: {np.abs(got - targets - soft * w).sum()} of {targets.sum()} tokens")
    if np.abs(got - targets).sum() > 2 * allowed:
        logging.getLogger(__name__).warning("targets out of reach: tokens %s for targets %s", got.tolist(), targets.tolist())
    return w, got - targets


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens, domains, posteriors, rate, copies and residuals.

    ``residuals`` has, for each domain, its expected tokens at the solved rates less
    its target; in sum they are within ``TOLERANCE`` of the budget where the targets
    can be reached.

    The target of a domain is its weight times the budget: all tokens of
    ``docs``, or more where the domain of the largest weight needs that to keep
    all it has. So documents of the wanted kind are not thinned out. ``copies`` is
    the rate, rounded up or down by a hash of the id with the right odds.

    Domains with a weight of 0 in ``targets`` are barred: documents that are more
    likely of them than of the others have rate 0, and the others are mixed by
    their posteriors over the other domains. With ``whole``, the budget lets each
    domain that is not barred keep all it has, and rates below 1 are raised to 1,
    so each document that is not barred has a copy; totals then exceed the targets
    by what was raised.
    """
    targets = targets or TARGETS
    scratch = Scratch(docs.sparkSession, "mixing")
    model = train(docs, labels)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType())]
    schema = T.StructType([*(docs.schema[c] for c in keep if c not in {a.name for a in added}), *added])
    base = [f.name for f in schema][: -len(added)]
    slim = T.StructType(added)
    barred = np.array([targets.get(d) == 0 for d in model.domains])
    table = scratch.save(docs.select("text").mapInArrow(_Posteriors(model, slim.names, barred), slim), "posteriors")
    present = domain_totals(table, len(model.domains))
    weights = np.array([targets.get(d, 0.0) for d in model.domains])
    if not weights.sum():
        weights = (~barred).astype(float)
    weights = weights / max(weights.sum(), 1e-9)
    if whole:
        budget = max((present[weights > 0] / weights[weights > 0]).tolist(), default=0.0)
    else:
        budget = max(present.sum(), present[weights.argmax()] / max(weights.max(), 1e-9))
    slopes, residuals = solve_rates(table, weights * budget)
    scratch.drop(table)
    final = _Posteriors(model, schema.names, barred, slopes, float(whole))
    mixed = docs.select(*dict.fromkeys([*base, "text"])).mapInArrow(final, schema)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    mixed = mixed.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    return mixed.withColumn("domains", F.array(*map(F.lit, model.domains))).withColumn("residuals", F.array(*map(F.lit, residuals.tolist())))


def accuracy(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic")) -> float:
    """Share of held-out labelled documents whose most likely domain is theirs; a quarter is held out, by crc32 of the id."""
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.where(~out), columns)
    truth = labels.where(out).dropna(subset=list(columns)).select("doc_id", F.concat_ws("_", *columns).alias("domain"))
    slim = T.StructType([T.StructField("domain", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType())])
    rows = docs.select("doc_id", "text").where("text is not null").join(truth, "doc_id").select("domain", "text")
    said = rows.mapInArrow(_Posteriors(model, slim.names, np.zeros(len(model.domains), dtype=bool)), slim)
    best = F.get(F.array(*map(F.lit, model.domains)), (F.array_position("posteriors", F.array_max("posteriors")) - 1).cast("int"))
    return said.agg(F.avg((best == F.col("domain")).cast("double"))).first()[0] or 0.0
