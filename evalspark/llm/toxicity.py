"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .store import free_name, given_id, landed, row_id

TRAIN_ROWS = 8192  # labelled rows that the model is fitted on, at most
SLOTS = 1 << 20  # places of the table that features are hashed into
LEAST = 3  # training rows that a feature must stand in
STEMS = (4, 5, 6, 7)  # bytes of a word's beginning that count as terms of their own
LEVELS = 4  # a term gives a feature for standing in a text once or more, twice or more, and so on
FACTORS = 8
RARE = 40.0  # training rows with a feature at which its factors act at half their size
DOUBT = 20.0  # chi-square at which a feature's own weight counts 0.35 of what it would
EPOCHS = 20
STEP, FACTOR_STEP, RIDGE = 0.3, 0.005, 1e-4
THRESHOLD = 0.7


class Model(NamedTuple):
    """By slot: `known`, whether the model has the feature, `linear` weights, and `place`, the row of a feature in
    `factors` (-1: none)."""

    bias: float
    known: np.ndarray
    linear: np.ndarray
    place: np.ndarray
    factors: np.ndarray


def terms_of(buf: np.ndarray, offs: np.ndarray, stems=STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and of their beginnings, and the text that each stands in."""
    buf = A.LOWER[buf]
    hashes, start, end, at = A.words(buf, offs, A.PUNCTUATION)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    prefix = A.WORDS.prefix(buf)
    found, rows = [hashes], [row]
    for size in stems:
        long = end - start > size
        begin = start[long]
        found.append(A.mix(A.WORDS.of(prefix, begin, begin + size) + A.U(size)))
        rows.append(row[long])
    return np.concatenate(found), np.concatenate(rows)


def features(buf: np.ndarray, offs: np.ndarray, slots: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot), ascending, of the features of each text, each once. `known` tells the slots that count; a term whose
    first level does not is left out whole, as its other levels stand in fewer texts still."""
    terms, row = terms_of(buf, offs)
    if known is not None:
        some = np.flatnonzero(known[_slot(terms, slots)])
        terms, row = terms[some], row[some]
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    level = np.arange(len(terms)) - np.repeat(head, np.diff(np.append(head, len(terms))))
    some = level < LEVELS
    slot = _slot(terms[some], slots, level[some])
    both = np.unique(row[some] * slots + slot)
    row, slot = both // slots, both % slots
    if known is not None:
        some = known[slot]
        row, slot = row[some], slot[some]
    return row, slot


def _slot(terms: np.ndarray, slots: int, level: np.ndarray | int = 0) -> np.ndarray:
    return (A.mix(terms + np.asarray(level).astype(A.U) * A.U(0x9E3779B97F4A7C15)) % A.U(slots)).astype(np.int64)


def _counts(slots: int):
    """Per task and group: in how many texts of each class a feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in A.byte_groups(batch.column("text"), 1 << 22):
                row, slot = features(buf, offs, slots)
                kinds, back = np.unique(slot, return_inverse=True)
                ones = np.bincount(back, weights=toxic[lo + row], minlength=len(kinds)).astype(np.int64)
                zeros = np.bincount(back, minlength=len(kinds)) - ones
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(ones), pa.array(zeros)], names=["slot", "ones", "zeros"])

    return run


def _listed(slots: int, known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in A.byte_groups(batch.column("text")):
                row, slot = features(buf, offs, slots, known)
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32)))
                columns = [*(batch.column(name).slice(lo, hi - lo) for name in ("at", "toxic")), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "toxic", "slots"])

    return run


def _trained(scale: np.ndarray, place: np.ndarray, value: np.ndarray, factors: int, epochs: int):
    """All training rows in one task, in the order of `at`; gives the bias alone, then weights and factors in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches).combine_chunks()
        if not found.num_rows:
            return
        found = found.take(pa.array(np.argsort(found.column("at").to_numpy(), kind="stable"))).combine_chunks()
        lists, truth = found.column("slots").chunk(0), found.column("toxic").to_numpy().astype(float)
        del found
        row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        bias, linear, factor = train(truth, row, lists.flatten().to_numpy(), scale, place, value, factors, epochs)
        parts = [("bias", 0, np.array([bias])), ("linear", 0, linear.astype(np.float32))]
        parts += [("factor", lo, factor[lo : lo + (1 << 14)].ravel()) for lo in range(0, len(factor), 1 << 14)]
        for name, lo, values in parts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lo]), pa.array([values.tobytes()])], names=["part", "lo", "values"])

    return run


def _distinct(values: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse, without sorting: `spots` has a place for each value that may occur, all zero."""
    spots[values] = 1
    kinds = np.flatnonzero(spots)
    spots[kinds] = np.arange(len(kinds))
    back = spots[values]
    spots[kinds] = 0
    return kinds, back


def train(
    labels: np.ndarray, rows: np.ndarray, slots: np.ndarray, scale: np.ndarray, place: np.ndarray, value: np.ndarray,
    factors: int, epochs: int,
):
    """Logistic loss, Adagrad on mini-batches: bias, linear weights by slot, and the factors of the features that have
    a `place`. Linear weights act by `scale`, factors by `value`, which is by place; `rows` ascend."""
    rng = np.random.default_rng(3)
    n = len(labels)
    bias, linear = float(np.log(labels.sum() / (n - labels.sum()))), np.zeros(len(scale))
    factor = rng.normal(0, 0.01, (int(place.max(initial=-1)) + 1, factors))
    sum_bias, sum_linear, sum_factor = 1e-8, np.full(len(scale), 1e-8), np.full(factor.shape, 1e-8)
    at = np.searchsorted(rows, np.arange(n + 1))
    spots = np.zeros(len(scale), np.int32)
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for b in range(0, n, 256):
            pick = shuffled[b : b + 256]
            size = at[pick + 1] - at[pick]
            i = np.repeat(np.arange(len(pick)), size)
            t = slots[np.repeat(at[pick] - (np.cumsum(size) - size), size) + np.arange(len(i))]
            logit = bias + np.bincount(i, (linear * scale)[t], len(pick))
            at_place = place[t]
            pair = at_place >= 0
            j, used, back = i[pair], *_distinct(at_place[pair], spots)
            own = factor[used] * value[used, None]
            columns = np.ascontiguousarray(own.T)
            total = np.stack([np.bincount(j, c[back], len(pick)) for c in columns] or [np.zeros(len(pick))], 1)
            logit += 0.5 * ((total**2).sum(1) - np.bincount(j, (own**2).sum(1)[back], len(pick)))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
            sum_bias += error.sum() ** 2
            bias -= STEP * error.sum() / np.sqrt(sum_bias)
            kinds, of = _distinct(t, spots)
            grad = np.bincount(of, error[i], len(kinds)) * scale[kinds] + RIDGE * linear[kinds]
            sum_linear[kinds] += grad**2
            linear[kinds] -= STEP * grad / np.sqrt(sum_linear[kinds])
            if factors and len(used):
                pull = np.ascontiguousarray((error[:, None] * total).T)
                grads = np.stack([np.bincount(back, p[j], len(used)) for p in pull], 1)
                grads -= np.bincount(back, error[j], len(used))[:, None] * own
                grads = grads * value[used, None] + RIDGE * factor[used]
                sum_factor[used] += grads**2
                factor[used] -= FACTOR_STEP * grads / np.sqrt(sum_factor[used])
    return bias, linear * scale, factor * value[:, None]


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, slots: int = SLOTS, factors: int = FACTORS, epochs: int = EPOCHS,
) -> Model:
    """Fit on at most `train_rows` labelled ids, those of least hash, one text each: of rows that share an id the
    greatest text counts, of several labels the greatest. All rows of `labels` may be used; leave out beforehand what is
    held out. Rows without id or label are skipped. Without both classes the model scores the share of ones.

    Terms are hashed into `slots` features; those in at least LEAST training rows stay, none is cut for what it tells by
    itself. Feature counts by class come from a Spark aggregate, of `slots` rows at most. The weight of a feature alone
    is damped by its chi-square statistic, so that many rare ones do not drown the few that tell. Every feature has
    factors, whatever it tells alone, so that pairs are learned whose halves tell nothing; those of a feature in few rows
    act by less, so that they do not learn single rows by heart.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    named = named.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # bounded by train_rows, so the broadcast is safe at any size
    sample = F.broadcast(named.orderBy(F.xxhash64("id"), "id").limit(train_rows))
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(sample, "id").groupBy("id", "toxic").agg(F.max("text").alias("text"))
    rows = landed(rows.select("toxic", "text"), "toxicity")
    ones = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones")).first()
    n, n1 = ones["n"], ones["ones"]
    if not 0 < n1 < n:
        return _constant(np.log((n1 + 1e-3) / (n - n1 + 1e-3)) if n else -7.0, factors)
    counts = rows.mapInArrow(_counts(slots), "slot long, ones long, zeros long").groupBy("slot")
    counts = counts.agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).filter(F.col("a") + F.col("b") >= LEAST).toArrow()
    if not counts.num_rows:
        return _constant(np.log(n1 / (n - n1)), factors)
    slot, a, b = (counts.column(c).to_numpy() for c in ("slot", "a", "b"))
    both, n0 = (a + b).astype(float), n - n1
    chi = (a * n0 - b * n1).astype(float) ** 2 * n / (both * (n - both + 1e-9) * n1 * n0)
    scale, place = np.zeros(slots), np.full(slots, -1, np.int32)
    scale[slot] = (chi / (chi + DOUBT)) ** 1.5
    order = np.argsort(slot) if factors else slot[:0]
    place[slot[order]] = np.arange(len(order))
    known = np.zeros(slots, bool)
    known[slot] = True
    # the lists, bounded by train_rows, meet in one task and not in the driver: of the model only what it learned comes back
    found = rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(_listed(slots, known), "at long, toxic int, slots array<int>")
    learner = _trained(scale, place, (both / (both + RARE))[order], factors, epochs)
    factor, learned = np.empty((len(order), factors)), {}
    for part in found.repartition(1).mapInArrow(learner, "part string, lo long, values binary").toLocalIterator():
        if part["part"] == "factor":
            values = np.frombuffer(part["values"]).reshape(-1, factors)
            factor[part["lo"] : part["lo"] + len(values)] = values
        else:
            learned[part["part"]] = part["values"]
    linear = np.frombuffer(learned["linear"], np.float32)
    return Model(float(np.frombuffer(learned["bias"])[0]), known, linear, place, factor)


def _constant(bias: float, factors: int) -> Model:
    return Model(bias, np.zeros(1, bool), np.zeros(1, np.float32), np.full(1, -1, np.int32), np.zeros((0, factors)))


def _scorer(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, own = len(model.known), (model.factors**2).sum(1)
        for batch in batches:
            scores = [np.empty(0)]
            for lo, hi, buf, offs in A.byte_groups(batch.column(batch.num_columns - 1)):
                logit = np.full(hi - lo, float(model.bias))
                if model.known.any():
                    row, slot = features(buf, offs, slots, model.known)
                    logit += np.bincount(row, model.linear[slot], hi - lo)
                    pair = model.place[slot] >= 0
                    row, at = row[pair], model.place[slot[pair]]
                    logit -= 0.5 * np.bincount(row, own[at], hi - lo)
                    for f in range(model.factors.shape[1]):
                        logit += 0.5 * np.bincount(row, model.factors[at, f], hi - lo) ** 2
                scores.append(1 / (1 + np.exp(-np.clip(logit, -700, 700))))
            columns = [*batch.columns[:-1], pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], name])

    return run


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `documents` and a score from 0 to 1 by the whole text alone. Null and empty texts score
    by the bias. A column that is named as the score column is replaced."""
    kept = documents.drop(score_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    read = F.col(text_col).cast("string").alias(free_name("text_read", kept.columns))
    return documents.select(*kept.columns, read).mapInArrow(_scorer(model, score_col), schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text and is not held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def toxic_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Fitted on labels of rows that are not held out.
    Rows that share an id are scored each by its own text."""
    model = fit(documents, labels.filter(~held_out(id_col)), id_col)
    docs = documents.select(row_id(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    scored = score(docs, model).select(given_id("id").alias(id_col), "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
