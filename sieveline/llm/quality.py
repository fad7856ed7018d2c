"""Quality classifier by Bradley-Terry pairwise ranking.

Documents have features: which words and beginnings of words they contain, of those
that tell good from bad in the sample, and shape statistics (shares of capitals,
symbols, digits and repeated words, word length and so on). The labels give preferences: a good document (quality 1, not toxic) is preferred to a
bad one. The score of a document is linear in its features; weights minimise the
logistic loss of the differences of features over all pairs of a good and a bad
document, with an L2 penalty. All documents are scored, and those below a quantile
of all scores are rejected. The quantile is given, or is the share of bad documents
among the labelled ones.

Weights are fitted on at most ``MAX_LABELLED`` labelled documents, those with the
smallest hash of doc_id; the feature scaling comes from the same sample. Scores and
the threshold cover all documents.

Defined results, one row a row: (doc_id, score, keep). Null and word-less texts have
no words and zeros as statistics, and are rejected: score null, keep false; they
don't count for the quantile. Ties at the threshold are kept. Labels without a
quality that aren't toxic, or of unknown documents, are ignored; of repeated labels the worst counts. Without
both kinds of labels all scores are 0 and all documents with words are kept. Other
columns are ignored, whatever their names. Very long texts are scored whole. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

MAX_LABELLED = 12_000
#: Pairs of documents that are held at once.
PAIRS_HELD = 1 << 18
ROUNDS = 150
L2 = 2e-4
#: Words in fewer documents of the sample, or that tell good from bad by fewer standard errors, have no weight.
MIN_DOCS = 5
Z = 4.0
#: Bytes of the beginnings of words that are features beside whole words.
PREFIXES = (4, 5)
_SYMBOL = np.zeros(256, bool)
for _c in b"#$%&*+/<=>@[\\]^_`{|}~!?":
    _SYMBOL[_c] = True
STATS = ("words", "word_length", "capitals", "symbols", "digits", "distinct", "top_word", "bar_marks", "line_repeats", "long_words")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stats by text, text of each mark, the mark). Marks are 32-bit hashes of words and of their beginnings, repeated as the words are."""
    n = len(texts)
    w = textvec.words(texts)
    raw, off = textvec._buffer(pa.compute.fill_null(texts.cast(pa.large_string()), ""))
    size = np.maximum(1, np.diff(off))

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    count = w.counts()
    some = np.maximum(1, count)
    capital = per_text((raw >= 65) & (raw <= 90))
    lower = per_text((raw >= 97) & (raw <= 122))
    symbol, bar = per_text(_SYMBOL[raw]), per_text(raw == ord("|"))
    digit = per_text((raw >= 48) & (raw <= 57))
    whole = (w.hash >> np.uint64(32)).astype(np.uint32)
    key = np.sort((w.doc.astype(np.int64) << 32) | whole)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    doc, times = key[edge] >> 32, np.diff(np.append(edge, len(key)))
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, times)
    length = (w.end - w.start).astype(np.int64)
    in_words = np.bincount(w.doc, weights=length, minlength=n)
    long_words = np.bincount(w.doc, weights=length > 16, minlength=n)
    # words that equal the word before them
    same = np.zeros(n)
    if len(w.hash) > 1:
        again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        same = np.bincount(w.doc[1:][again], minlength=n)
    stats = np.stack(
        [np.log1p(count), in_words / some, capital / np.maximum(1, capital + lower), symbol / size, digit / size, distinct / np.sqrt(some), top / some, bar / some, same / some, long_words / some], axis=1
    ).astype(np.float32)
    marks, owners = [whole], [w.doc]
    if len(w.start):
        buf = np.concatenate([w.buf, np.zeros(8, np.uint8)])
        packed = np.zeros(len(w.start), np.uint64)
        for j in range(max(PREFIXES)):
            packed |= buf[w.start + j].astype(np.uint64) << np.uint64(8 * j)
            if j + 1 in PREFIXES:
                on = length > j + 1
                marks.append((textvec.mix(packed[on] + np.uint64((j + 1) << 56)) >> np.uint64(32)).astype(np.uint32))
                owners.append(w.doc[on])
    return stats, np.concatenate(owners), np.concatenate(marks)


def _distinct(doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort((doc.astype(np.uint64) << np.uint64(32)) | mark)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


@dataclass
class Model:
    marks: np.ndarray  # sorted hashes of the words and beginnings that have a weight
    weight: np.ndarray
    stat: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.marks >> np.uint32(12)] = True

    def columns(self, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, index of mark) of the marks that have a weight, once for each text."""
        on = self.maybe[mark >> np.uint32(12)]
        doc, mark = doc[on], mark[on]
        at = np.searchsorted(self.marks, mark)
        at[at == len(self.marks)] = 0
        on = self.marks[at] == mark if len(self.marks) else np.zeros(len(mark), bool)
        doc, at = _distinct(doc[on], at[on].astype(np.uint32))
        return doc, at.astype(np.int64)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether the text has words)"""
        stats, doc, mark = features(texts)
        doc, at = self.columns(doc, mark)
        s = np.bincount(doc, weights=self.weight[at], minlength=len(texts))
        return s + self._shape(stats) @ self.stat, stats[:, 0] > 0

    def _shape(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([x, np.abs(x), np.maximum(0, x - 2)], axis=1)


def telling(doc: np.ndarray, mark: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The marks that are in at least MIN_DOCS texts and whose shares among good and bad texts differ by Z standard errors."""
    values, total = np.unique(mark, return_counts=True)
    values, total = values[total >= MIN_DOCS], total[total >= MIN_DOCS]
    bad_values, bad_total = np.unique(mark[~good[doc]], return_counts=True)
    at = np.minimum(np.searchsorted(bad_values, values), max(0, len(bad_values) - 1))
    in_bad = np.where(bad_values[at] == values, bad_total[at], 0) if len(bad_values) else np.zeros(len(values))
    share = (~good).mean()
    z = (in_bad - share * total) / np.sqrt(np.maximum(1e-9, share * (1 - share) * total))
    return values[np.abs(z) >= Z]


def pushes(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The derivatives of the mean logistic loss over all pairs, by the scores of the good and of the bad documents."""
    good, bad = np.exp(np.clip(good, -300, 300)), np.exp(-np.clip(bad, -300, 300))
    by_good, by_bad = np.zeros(len(good)), np.zeros(len(bad))
    step = max(1, PAIRS_HELD // len(bad))
    for i in range(0, len(good), step):
        push = np.multiply.outer(good[i : i + step], bad)
        push += 1
        np.divide(-1, push, out=push)
        by_good[i : i + step] = push.sum(axis=1)
        by_bad -= push.sum(axis=0)
    n = len(good) * len(bad)
    return by_good / n, by_bad / n


def fit_pairs(stats: np.ndarray, doc: np.ndarray, mark: np.ndarray, good: np.ndarray) -> Model:
    """Bradley-Terry weights from all pairs of a good and a bad document, by Adam. Marks are distinct for each text."""
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    k = stats.shape[1] * 3
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(k), mean, scale)
    marks = telling(doc, mark, good)
    m = len(marks)
    model = Model(marks, np.zeros(m), np.zeros(k), mean, scale)
    doc, col = model.columns(doc, mark)
    x = model._shape(stats).astype(np.float64)
    theta = np.zeros(m + k)
    first, second = np.zeros(m + k), np.zeros(m + k)
    n = len(good)
    for step in range(1, ROUNDS + 1):
        s = np.bincount(doc, weights=theta[:m][col], minlength=n) + x @ theta[m:]
        g = np.zeros(n)
        g[yes], g[no] = pushes(s[yes], s[no])
        grad = np.concatenate([np.bincount(col, weights=g[doc], minlength=m), x.T @ g]) + L2 * theta
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        theta -= 0.05 * (1 - step / (ROUNDS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.weight, model.stat = theta[:m], theta[m:]
    return model


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text", textvec.FINE_BYTES):
            stats, doc, mark = features(part.column("text"))
            doc, mark = _distinct(doc, mark)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(first), pa.array(mark.view(np.int32)))
            shape = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("bad"), shape, marks], names=["doc_id", "bad", "stats", "marks"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Model, float]:
    """(model, share of bad documents among all labelled ones)."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.filter("doc_id is not null and (quality is not null or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad.cast("int")).alias("bad"))
    share = marks.agg(F.avg("bad").alias("share")).collect()[0].share
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of 12 bytes
    sample = _texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(_extract, "doc_id long, bad int, stats array<float>, marks array<int>")
    table = sample.toArrow()
    table = table.take(np.argsort(np.asarray(table.column("doc_id")), kind="stable"))
    stats = np.asarray(table.column("stats").combine_chunks().flatten(), np.float32).reshape(-1, len(STATS))
    if not len(stats):
        k = len(STATS)
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(3 * k), np.zeros(k), np.ones(k)), 0.0
    lists = table.column("marks").combine_chunks()
    mark = np.asarray(lists.flatten(), np.int32).view(np.uint32)
    doc = np.repeat(np.arange(len(stats), dtype=np.int32), np.asarray(pa.compute.list_value_length(lists)))
    good = np.asarray(table.column("bad")) == 0
    del table, lists
    return fit_pairs(stats, doc, mark, good), float(share or 0.0)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, "text", textvec.FINE_BYTES):
                s, ok = model.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64(), mask=~ok)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row a row."""
    return _texts(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def threshold(scores: DataFrame, quantile: float) -> float | None:
    """The quantile of all scores, from a sketch of bounded size; None without scores."""
    return scores.agg(F.percentile_approx("score", F.lit(float(quantile)), F.lit(100_000)).alias("t")).collect()[0].t


def _cutoff(docs: DataFrame, labels: DataFrame, quantile: float | None) -> tuple[Model, DataFrame, float | None]:
    model, share = fit(docs, labels)
    scores = scratch.save(score(docs, model), "quality-scores")
    return model, scores, threshold(scores, share if quantile is None else quantile)


def classify(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    _, scores, t = _cutoff(docs, labels, quantile)
    keep = F.col("score").isNotNull() if t is None else F.coalesce(F.col("score") >= F.lit(t), F.lit(False))
    return scores.select("doc_id", "score", keep.alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns. Texts are scored
    once for the quantile and once more to filter them, which costs less than to move
    them to their scores."""
    model, _, t = _cutoff(docs, labels, quantile)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: pa.Array) -> np.ndarray:
        s, ok = shared.value.scores(texts)
        return ok if t is None else ok & (s >= t)

    return textvec.keep_rows(docs, good, textvec.FINE_BYTES)
