"""Language identification of mixed-language text, span by span.

Every word is scored for every candidate language, and a Viterbi pass over the words
of a text with a penalty for each switch labels spans. The candidates of a word are
narrowed by the range of its script: languages trained from labelled texts compete
for words of the scripts they were seen in; a script with one dominant language
(``SCRIPTS``) has that one as well if no trained language uses it. Words of digits
only fit any language. A word's score is the log likelihood of its byte trigrams
(with its edges) under the language's smoothed trigram model, relative to the best
candidate and at worst ``-CLIP``; a language outside the word's script scores
``-OUTSIDE``.

A text in which no stretch of words gains more by another language than a switch
costs has one language; that is seen from running sums. The others go through
Viterbi together, a step of the array for the n-th word of all of them.

Models are fitted on at most ``TRAIN_DOCS`` texts of each language, those with the
smallest hash of doc_id. A language is a candidate for the scripts that more than
``SEEN`` of the letters' words of its sample have. Ties go to the language that sorts
first. Scores compare known languages, so a text of an unknown language in a script
that is known gets the nearest known one and isn't rejected.

Defined results, one row a row: (doc_id, lang, share, spans, keep). ``spans`` lists
(start, end, lang) in words, ``lang`` has the most words, ``share`` is its part of
all words. Null and word-less texts are ``und`` with share 0 and no spans. Texts
whose language isn't in ``accepted``, or has a smaller share than ``MIN_SHARE``, are
not to be kept. Without any labelled text only the languages of scripts remain, and
words of other scripts are ``und``. Repeated rows are labelled alike; doc_id may be
null; other columns are ignored, whatever their names. Very long texts are labelled
whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec

TRAIN_DOCS = 300
SWITCH = 18.0
CLIP = 10.0
OUTSIDE = 30.0
MIN_SHARE = 0.5
SEEN = 0.01
_BITS = 16

#: Scripts by the range of code points, and the language that a script stands for.
SCRIPTS = [
    ("latin", 0x41, 0x24F, "und"), ("greek", 0x370, 0x3FF, "el"), ("cyrillic", 0x400, 0x52F, "ru"), ("armenian", 0x530, 0x58F, "hy"),
    ("hebrew", 0x590, 0x5FF, "he"), ("arabic", 0x600, 0x7FF, "ar"), ("devanagari", 0x900, 0x97F, "hi"), ("thai", 0xE00, 0xE7F, "th"),
    ("georgian", 0x10A0, 0x10FF, "ka"), ("latin", 0x1E00, 0x1EFF, "und"), ("greek", 0x1F00, 0x1FFF, "el"), ("kana", 0x3040, 0x30FF, "ja"),
    ("han", 0x3400, 0x9FFF, "zh"), ("hangul", 0xAC00, 0xD7AF, "ko"),
]
NAMES = list(dict.fromkeys(s for s, *_ in SCRIPTS)) + ["other"]
_OTHER = len(NAMES) - 1
_ANY = 255  # words of digits only
_SCRIPT_OF = np.full(0x10000, _OTHER, np.uint8)
for _name, _from, _to, _ in SCRIPTS:
    _SCRIPT_OF[_from : _to + 1] = NAMES.index(_name)


def word_scripts(w: textvec.Words) -> np.ndarray:
    """The script of each word's first character that isn't a digit."""
    buf = w.buf
    out = np.full(len(w.start), _ANY, np.uint8)
    if not len(out):
        return out
    # the first byte of each word that isn't an ASCII digit
    after = np.append(np.cumsum((buf < 48) | (buf > 57)), 0)
    seen = after[w.start] - ((buf[w.start] < 48) | (buf[w.start] > 57))
    spot = np.searchsorted(after[:-1], seen + 1)
    ok = np.flatnonzero(spot < w.end)
    at = spot[ok]
    pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, ((b0 & 31) << 6) | b1, np.where(b0 < 0xF0, ((b0 & 15) << 12) | (b1 << 6) | b2, 0xFFFF)))
    out[ok] = _SCRIPT_OF[code]
    return out


def _trigrams(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the trigram around each byte of each word."""
    buf = np.where(textvec._WORD[w.buf], w.buf, 32).astype(np.uint32)
    edged = np.concatenate([[32], buf, [32]]).astype(np.uint32)
    size = w.end - w.start
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + w.start[word]
    left, right = edged[at], edged[at + 2]
    # texts border on each other without a separator
    left[at == w.start[word]] = 32
    right[at + 1 == w.end[word]] = 32
    code = (left << np.uint32(16)) | (buf[at] << np.uint32(8)) | right
    return (code * np.uint32(2654435761)) >> np.uint32(32 - _BITS), word


@dataclass
class Model:
    langs: list[str]  # sorted
    table: np.ndarray  # (buckets, languages) log probabilities; 0 for untrained ones
    fits: np.ndarray  # (scripts, languages) whether a language is a candidate

    def scores(self, w: textvec.Words) -> np.ndarray:
        """(words, languages): log likelihood relative to the best candidate, clipped."""
        n, k = len(w.start), len(self.langs)
        out = np.zeros((n, k), np.float32)
        if not n:
            return out
        bucket, word = _trigrams(w)
        first = np.concatenate([[0], np.cumsum(w.end - w.start)[:-1]])
        for j in range(k):
            if self.table[:, j].any():
                out[:, j] = np.add.reduceat(self.table[bucket, j], first)
        script = word_scripts(w)
        digits = script == _ANY
        fits = self.fits[np.where(digits, 0, script)]
        out[~fits] = -np.inf
        best = out.max(axis=1, keepdims=True)
        out -= np.where(np.isfinite(best), best, 0)
        np.maximum(out, -CLIP, out=out)
        out[~fits] = -OUTSIDE
        out[digits] = 0
        return out


def train(texts: list[tuple[str, str]]) -> Model:
    """A model from (language, text) pairs."""
    trained = sorted({lang for lang, _ in texts})
    counts = np.zeros((1 << _BITS, len(trained)))
    used = np.zeros((len(NAMES), len(trained)))
    for j, lang in enumerate(trained):
        # in slices, so that memory doesn't follow the sample
        batch = pa.record_batch({"text": pa.array([t for name, t in texts if name == lang], pa.string())})
        for part in textvec.slices(batch, "text", textvec.FINE_BYTES):
            w = textvec.words(part.column("text"), hashed=False)
            counts[:, j] += np.bincount(_trigrams(w)[0], minlength=1 << _BITS)
            script = word_scripts(w)
            used[:, j] += np.bincount(script[script != _ANY], minlength=len(NAMES))
    seen = used > SEEN * np.maximum(1, used.sum(axis=0))
    langs = list(trained)
    for name, _, _, lang in SCRIPTS:
        if lang not in langs and not seen[NAMES.index(name)].any():
            langs.append(lang)
    if "und" not in langs:
        langs.append("und")
    langs.sort()
    table = np.zeros((1 << _BITS, len(langs)), np.float32)
    fits = np.zeros((len(NAMES), len(langs)), bool)
    for j, lang in enumerate(trained):
        smooth = counts[:, j] + 0.05
        table[:, langs.index(lang)] = np.log(smooth / smooth.sum())
        fits[:, langs.index(lang)] = seen[:, j]
    for name, _, _, lang in SCRIPTS:
        if lang not in trained and not fits[NAMES.index(name)].any():
            fits[NAMES.index(name), langs.index(lang)] = True
    fits[~fits.any(axis=1), langs.index("und")] = True
    return Model(langs, table, fits)


def one_language(s: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """For each text its language if no switch can gain, else -1. s: (words, languages)."""
    n, k = len(first) - 1, s.shape[1]
    total = np.zeros((len(s) + 1, k))
    np.cumsum(s, axis=0, out=total[1:])
    sums = total[first[1:]] - total[first[:-1]]
    best = sums.argmax(axis=1) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    own = s[np.arange(len(s)), best[doc]]
    single = np.ones(n, bool)
    for j in range(k):
        gain = s[:, j].astype(np.float64) - own
        if not (gain > 0).any():
            continue
        c = np.concatenate([[0.0], np.cumsum(gain)])
        # a drop between texts, below all that a text can reach, restarts the minimum
        drop = np.abs(gain).sum() + 1.0
        low = np.minimum.accumulate(c[:-1] - drop * doc) + drop * doc
        reach = c[1:] - low
        over = np.unique(doc[reach >= switch])
        single[over] = False
    return np.where(single, best, -1)


def viterbi(s: np.ndarray, first: np.ndarray, texts: np.ndarray, switch: float) -> dict[int, np.ndarray]:
    """The best labels of the words of each of the texts, in step over all of them."""
    size = first[texts + 1] - first[texts]
    by = np.argsort(-size, kind="stable")
    texts, size = texts[by], size[by]
    if not len(texts):
        return {}
    k = s.shape[1]
    start = first[texts]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts of at least so many words
    value = s[start].astype(np.float64)
    stay = np.zeros((int(size.sum()), k), bool)
    source = np.zeros(int(size.sum()), np.int16)
    row = np.concatenate([[0], np.cumsum(active)[:-1]])
    for t in range(1, int(size[0])):
        m = active[t]
        v = value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top] - switch
        keep = v >= jump[:, None]
        stay[row[t] : row[t] + m] = keep
        source[row[t] : row[t] + m] = top
        value[:m] = np.where(keep, v, jump[:, None]) + s[start[:m] + t]
    labels = {int(x): np.zeros(n, np.int16) for x, n in zip(texts, size, strict=True)}
    now = value.argmax(axis=1)
    flat = np.zeros(int(size.sum()), np.int16)
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        flat[row[t] : row[t] + m] = now[:m]
        if t:
            keep = stay[np.arange(row[t], row[t] + m), now[:m]]
            now[:m] = np.where(keep, now[:m], source[row[t] : row[t] + m])
    for i, (x, n) in enumerate(zip(texts, size, strict=True)):
        labels[int(x)][:] = flat[row[:n] + i]
    return labels


def _label(model, switch: float, accepted: list[str] | None, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        ok = set(m.langs) - {"und"} if accepted is None else set(accepted) - {"und"}
        for batch in batches:
            for part in textvec.slices(batch, "text", textvec.FINE_BYTES):
                w = textvec.words(part.column("text"), hashed=False)
                s = m.scores(w)
                single = one_language(s, w.first, switch)
                mixed = viterbi(s, w.first, np.flatnonzero(single < 0), switch)
                langs, shares, spans = [], [], []
                for i, n in enumerate(w.counts().tolist()):
                    if not n:
                        langs.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    if i not in mixed:
                        lang = m.langs[single[i]]
                        langs.append(lang)
                        shares.append(1.0)
                        spans.append([{"start": 0, "end": n, "lang": lang}])
                        continue
                    y = mixed[i]
                    part_of = np.bincount(y, minlength=len(m.langs))
                    langs.append(m.langs[int(part_of.argmax())])
                    shares.append(float(part_of.max() / n))
                    ends = np.append(np.flatnonzero(np.diff(y)) + 1, n).tolist()
                    spans.append([{"start": a, "end": b, "lang": m.langs[y[a]]} for a, b in zip([0, *ends], ends, strict=False)])
                keep = [lang in ok and share >= min_share for lang, share in zip(langs, shares, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind), pa.array(keep, pa.bool_())],
                    names=["doc_id", "lang", "share", "spans", "keep"],
                )

    return run


SCHEMA = "doc_id long, lang string, share double, spans array<struct<start:int,end:int,lang:string>>, keep boolean"


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """labelled(doc_id, text, lang): fit on at most train_docs texts of each language."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and lang is not null and text is not null")
    # ids of each language by hash; a task passes on train_docs of each at most
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    keys = rows.select("doc_id", "lang").distinct().withColumn("place", first).filter(F.col("place") <= train_docs)
    chosen = [(r.doc_id, r.lang) for r in keys.select("doc_id", "lang").collect()]
    if not chosen:
        return train([])
    wanted = rows.sparkSession.createDataFrame(chosen, "doc_id long, lang string")
    sample = rows.join(F.broadcast(wanted), ["doc_id", "lang"]).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"])
    return train([(r.lang, r.text) for r in sample.select("lang", "text").collect()])


def identify(docs: DataFrame, model: Model, accepted: list[str] | None = None, switch: float = SWITCH, min_share: float = MIN_SHARE) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_label(shared, switch, accepted, min_share), SCHEMA)


def kept(docs: DataFrame, model: Model, accepted: list[str] | None = None, switch: float = SWITCH, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs whose text has an accepted language as its main one, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: pa.Array) -> np.ndarray:
        rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
        parts = _label(shared, switch, accepted, min_share)(iter([rows]))
        return np.concatenate([np.zeros(0, bool), *(np.asarray(p.column("keep")) for p in parts)])

    return textvec.keep_rows(docs, good, textvec.FINE_BYTES)
