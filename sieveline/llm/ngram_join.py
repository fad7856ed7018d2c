"""N-gram Jaccard self-join of documents: a size-aware heavy-light set join.

Each text is the set of its word n-grams. All pairs with Jaccard similarity of at
least ``threshold`` are found, exactly (up to equality of hashes, of 64 bits in the
search and 48 in the comparison of two sets):

1. Texts with equal sets collapse to one set. In the same pass a table of
   ``ORDER_BUCKETS`` counters, filled over the whole corpus, gives every n-gram an
   order: by its counter, then by its hash. Any such order makes the prefix filter
   exact; counting makes it put n-grams that very many documents share last.
2. Two sets of that similarity share SUBSET n-grams (or all they must share, if that
   is less) among the first n - ceil(t n) + SUBSET of each, their prefixes. *Light*
   sets list each SUBSET-element subset of the prefix, and light pairs meet on an
   equal one. *Heavy* sets scan the inverted lists of their prefix, and pairs that
   meet in SUBSET lists are candidates. The size from which sets are heavy is where
   the summed cost of both is least. Size and position filters drop pairs that can't
   reach the threshold.
   A task lists equal sets once, however many copies it reads. A key that more than
   ``HOT`` sets may have, by the counters of its n-grams, is cut: sets are spread over
   g parts by hash, and each pair of parts is a list of its own, so no list outgrows a
   task and every pair of sets still meets in exactly one of them.
3. The lists are made where their key is, those of the same sets as one row, and then
   move to where their first set is before they are turned into pairs. Most lists of a
   group of copies meet there, so pairs are counted where they arise: what is shuffled
   follows the lists, not the square of the group times the length of its texts.
4. Candidates are verified on their whole sets. Each pair goes to a cell that nearly all
   pairs of its group of similar sets have in common, so the sets of a group of copies
   travel once, not once a pair; a cell of very many pairs is cut into a grid.
5. ``classes`` and ``one_of_each`` don't list the pairs of large groups of near copies. In
   lists of ``LONG`` sets or more the set that is in most of them is a *pivot* P. The sets
   similar to it are its core, and |x & y| >= |x & P| + |y & P| - |P| shows from two numbers
   g(x) + g(y) >= 0, with g(x) = (1 + t) |x & P| - t |x| - (1 + t) |P| / 2, that x and y are
   similar. Such pairs are counted by sorting g; lists leave them out, and all others go the
   way above. A set has one pivot at most, so no pair counts twice.

``classes`` has a row a document: the class (connected by similar pairs) it is in, and
the number of documents it is similar to. It is counted from pairs of distinct sets and
the sizes of the groups of equal ones, so copies aren't expanded into pairs.
``jaccard_pairs`` does expand them.

Defined results. Null and word-less texts have the empty set and are in no pair: they
are classes of one without links. Texts of fewer than n words are one n-gram of all
their words. Very long texts are taken whole. Rows without doc_id take no part. A
repeated doc_id, or a repeated row, is one document whose similarity to another is the
largest over its rows; it is never paired with itself, and joins the classes of all its
texts. Ties need no rule: all pairs at or above the threshold count, and a class has
its smallest doc_id as its id. Columns other than doc_id and text are ignored, whatever
their names. No rows give no pairs and no classes. Partners and candidates are not
capped; hot lists cost the pairs that no core covers. Sets of a doc_id of several texts are
in no core, as its links count once whatever texts they come from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textvec

N = 2
THRESHOLD = 0.6
#: Size of the subsets that light sets enumerate, and of the overlap of prefixes that heavy ones need.
SUBSET = 3
#: Counters that order the n-grams; a broadcast of 4 bytes each, at any corpus size.
ORDER_BUCKETS = 1 << 20
#: The filter of candidate sets has 16 bits for each, at most so many in all (a
#: broadcast of 64 MB). Beyond, it lets more sets through to the join, which is exact.
FILTER_BITS = 1 << 29
#: Pairs of a cell above which it is cut into a grid, and of a group of cells that one call verifies.
CELL_PAIRS = 100_000
GROUP_PAIRS = 2_000
#: Entries of a list up to which those that can't be similar to any other are dropped.
SHORT = 64
#: Sets of a list from which it has a pivot.
LONG = 128
#: Sets of a list, by the counters, above which it is cut into pairs of parts.
HOT = 1 << 15
#: Pairs that a task counts in memory at once.
HELD_PAIRS = 1 << 21

_CHUNK = 1 << 14
_SUBSET_AT = 0x7FFFFFFF  # the position of entries that are subsets
_SIZE = (1 << 29) - 1  # below the flag of an entry: 0, or 2 and 3 for the sides of a list of two parts


def _order_of(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices that sort by doc, then key; doc counts texts of one slice."""
    by = np.argsort(key, kind="stable")
    return by[np.argsort(doc[by].astype(np.uint32), kind="stable")]


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text index), sorted by text index and hash."""
    h, doc = textvec.grams(textvec.words(texts), n)
    order = _order_of(doc, h)
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set's content: two sums of mixed elements, mixed."""
    sums = []
    for k in (0x51ED270B, 0x7FB5D329):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(textvec.mix(h ^ np.uint64(k)), out=total[1:])
        sums.append(total[first[1:]] - total[first[:-1]])
    size = np.diff(first).astype(np.uint64)
    return textvec.mix(textvec.mix(sums[0]) + sums[1] * np.uint64(3) + size).view(np.int64)


def _new_sets(sid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether each set is new to the task; seen has 8 bytes for each text of a split at most."""
    fresh = np.zeros(len(sid), bool)
    values, at = np.unique(sid, return_index=True)
    new = [i for v, i in zip(values.tolist(), at.tolist(), strict=True) if v not in seen]
    fresh[new] = True
    seen.update(sid[new].tolist())
    return fresh


def _scan(n: int, buckets: int):
    """One row a document (chunk null), then the counters in chunks; a task counts equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int32)
        seen: set[int] = set()
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                h, doc = _sets(part.column("text"), n)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                size = np.diff(first)
                sid = _set_ids(h, first)
                counted = h[_new_sets(sid, seen)[doc]]
                np.add(counts, np.bincount((counted & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), out=counts, casting="unsafe")
                nulls = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sid), pa.array(size.astype(np.int32)), nulls, pa.nulls(part.num_rows, pa.binary())],
                    names=["doc_id", "sid", "n", "chunk", "counts"],
                )
        if counts.any():
            chunks = range(0, buckets, _CHUNK)
            k = len(chunks)
            packed = [pa.compress(counts[i : i + _CHUNK].astype(np.uint32).tobytes(), "zstd", asbytes=True) for i in chunks]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "sid", "n", "chunk", "counts"],
            )

    return run


def _add_up(size: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(blob, size * 4, "zstd", asbytes=True), np.uint32)
        total = np.minimum(total, (1 << 31) - 1).astype(np.uint32)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def prefix_size(n: int, t: float) -> int:
    return min(n, n - math.ceil(t * n - 1e-9) + SUBSET)


def boundary(sizes: dict[int, int], t: float, probe: float) -> int:
    """The largest light size, by cost in rows. A light set of n elements lists the
    subsets of its prefix; a heavy one has a row an element of its prefix, each of
    which also meets ``probe`` others; so has a light set that a heavy one may match."""
    light = {n: c * math.comb(prefix_size(n, t), SUBSET) for n, c in sizes.items()}
    rows = {n: c * prefix_size(n, t) for n, c in sizes.items()}
    best, at = math.inf, 0
    for x in [0, *sorted(sizes)]:
        cost = sum(light[n] if n <= x else rows[n] * (1 + probe) for n in sizes)
        cost += sum(rows[n] for n in sizes if t * (x + 1) <= n <= x)
        if cost < best:
            best, at = cost, x
        elif x > 400 and cost > 4 * best:
            break
    return at


def _probe_length(counts: np.ndarray, t: float) -> float:
    """Other entries that an element of a prefix meets: the mean counter over the
    rarest (1 - t) of all occurrences, above the median counter."""
    c = np.sort(counts[counts > 0].astype(np.float64))
    if not len(c):
        return 0.0
    low = c[: max(1, int(np.searchsorted(np.cumsum(c), (1 - t) * c.sum())))]
    return max(0.0, float((low * low).sum() / low.sum() - np.median(c)))


@lru_cache(maxsize=256)
def _subsets(m: int) -> np.ndarray:
    """The SUBSET-element subsets of range(m), a row each."""
    return np.array(list(combinations(range(m), SUBSET)))


def _parted(key: np.ndarray, sid: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of keys with several parts, once for each pair of parts that has the set's own."""
    own = (textvec.mix(sid.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % parts.astype(np.uint64)).astype(np.int64)
    entry = np.repeat(np.arange(len(key)), parts)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = own[entry]
    low, high = np.minimum(own, other), np.maximum(own, other)
    flag = np.where(low == high, 0, np.where(own == low, 2, 3))
    key = textvec.mix(textvec.mix(key[entry] + low.astype(np.uint64)) + high.astype(np.uint64))
    return key, sid[entry], at[entry] | (flag << 61)


def _postings(n: int, t: float, light: int, order, hot: int):
    """Rows (key, sid, flag << 61 | size << 32 | position); subsets have the last position."""
    tiny = next(k for k in range(1, 1000) if math.ceil(t * k - 1e-9) >= SUBSET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        mask = np.uint64(len(counts) - 1)
        seen: set[int] = set()
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                h, doc = _sets(part.column("text"), n)
                if not len(h):
                    continue
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sid = _set_ids(h, first)
                size = np.diff(first)
                fresh = _new_sets(sid, seen)
                count = counts[h & mask]
                by = _order_of(doc, (count.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
                h, count = h[by], count[by]
                pos = np.arange(len(h)) - first[doc]
                mine = size[doc]
                need = np.ceil(t * mine - 1e-9).astype(np.int64)
                heavy = (mine > light) | (mine < tiny)
                listed = fresh[doc] & (pos < mine - need + SUBSET) & (heavy | (mine >= t * (light + 1) - 1e-9) | (mine <= (tiny - 1) / t + 1e-9))
                keys, sids, packed, most = [h[listed]], [sid[doc[listed]]], [(mine[listed] << 32) | pos[listed]], [count[listed]]
                small = np.flatnonzero(fresh & (size >= tiny) & (size <= light))
                lengths = np.array([prefix_size(m, t) for m in range(light + 1)])[size[small]]
                for m in np.unique(lengths).tolist():
                    sets = small[lengths == m]
                    spot = first[sets][:, None] + np.arange(m)
                    line = np.argsort(h[spot], axis=1)
                    x, c = (np.take_along_axis(v[spot], line, axis=1) for v in (h, count))
                    chosen = _subsets(m)
                    key, least = np.zeros((len(sets), len(chosen)), np.uint64), None
                    for k in range(SUBSET):
                        key = textvec.mix(key * np.uint64(0x9FB21C651E98DF25) + x[:, chosen[:, k]])
                        least = c[:, chosen[:, k]] if least is None else np.minimum(least, c[:, chosen[:, k]])
                    keys.append(key.ravel())
                    sids.append(np.repeat(sid[sets], len(chosen)))
                    packed.append(np.repeat((size[sets] << 32) | _SUBSET_AT, len(chosen)))
                    most.append(least.ravel())
                key, own, at, most = (np.concatenate(v) for v in (keys, sids, packed, most))
                parts = -(-most.astype(np.int64) // hot)
                many = parts > 1
                if many.any():
                    more = _parted(key[many], own[many], at[many], parts[many])
                    key, own, at = (np.concatenate([v[~many], w]) for v, w in zip((key, own, at), more, strict=True))
                # 48 bits of a key are enough to meet by, and the zeros in front take no room when moved
                yield pa.RecordBatch.from_arrays([pa.array((key & ~np.uint64(0xFFFF)).view(np.int64)), pa.array(own), pa.array(at)], names=["key", "sid", "at"])

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by key, in batches that don't part equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        tail = int(np.searchsorted(keys, keys[-1]))
        if tail == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(batch)
            continue
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        if tail:
            yield pa.concat_batches([*held, batch.slice(0, tail)])
        held = [batch.slice(tail)]
    if held:
        yield pa.concat_batches(held)


def _met(n_i: np.ndarray, n_j: np.ndarray, pos_i: np.ndarray, pos_j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether two sets that meet at these positions can be similar, and in how much they overlap then."""
    need = t / (1 + t) * (n_i.astype(np.float64) + n_j) - 1e-9
    ok = (n_i >= t * n_j - 1e-9) & (n_j >= t * n_i - 1e-9)
    return ok & ((pos_i == 0x7FFFFFFF) | (np.minimum(n_i - pos_i, n_j - pos_j) - 1 >= need - SUBSET)), need


def _useful(run: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float) -> np.ndarray:
    """Entries that can be similar to another of their list, in lists of up to SHORT entries; all of longer ones."""
    length = np.bincount(run)[run]
    first = np.searchsorted(run, run)
    after = first + length - np.arange(len(run)) - 1
    useful = length > SHORT
    short = np.flatnonzero(~useful)
    for step in range(1, SHORT):
        i = short[after[short] >= step]
        if not len(i):
            break
        j = i + step
        ok, _ = _met(size[i], size[j], pos[i], pos[j], t)
        useful[i[ok]] = True
        useful[j[ok]] = True
    return useful


def _shared_rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A row (first set, sets, sizes, places of each list one after the other) for all lists of the same sets."""
    run = np.concatenate([np.full(len(p[0]), i, np.int64) << 40 for i, p in enumerate(parts)]) + np.concatenate([p[0] for p in parts])
    sid, size, pos = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    length = np.diff(np.append(first, len(run)))
    content = _set_ids(sid.view(np.uint64) + (size >> 29).astype(np.uint64), np.append(first, len(run)))
    order = np.lexsort((length, content))
    c, n = content[order], length[order]
    fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (n[1:] != n[:-1])])
    lead = order[fresh]

    def entries(lists: np.ndarray) -> np.ndarray:
        k = length[lists]
        return np.repeat(first[lists], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)

    one, every = entries(lead), entries(order)
    many = np.add.reduceat(n, np.flatnonzero(fresh))
    off = pa.array(np.concatenate([[0], np.cumsum(length[lead])]).astype(np.int32))
    off_places = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(sid[first[lead]]),
            pa.ListArray.from_arrays(off, pa.array(sid[one])),
            pa.ListArray.from_arrays(off, pa.array(size[one])),
            pa.ListArray.from_arrays(off_places, pa.array(pos[every])),
        ],
        names=["lead", "sids", "sizes", "places"],
    )


def _lists(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: the lists of two sets or more, those of the same sets in one row."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for batch in whole_runs(batches, "key"):
        key, sid, at = (np.asarray(batch.column(c)) for c in ("key", "sid", "at"))
        run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        many = np.bincount(run)[run] > 1
        if not many.any():
            continue
        run, sid, at = run[many], sid[many], at[many]
        order = np.lexsort((sid, run))
        run, sid, at = run[order], sid[order], at[order]
        # equal sets have equal postings
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (sid[1:] != sid[:-1])])
        run, sid, at = run[fresh], sid[fresh], at[fresh]
        many = np.bincount(run)[run] > 1
        run, sid, at = run[many], sid[many], at[many]
        size, pos = (at >> 32).astype(np.int32), (at & 0x7FFFFFFF).astype(np.int32)
        keep = _useful(run, size & _SIZE, pos, t)
        run, sid, size, pos = run[keep], sid[keep], size[keep], pos[keep]
        if not len(run):
            continue
        held.append((run, sid, size, pos))
        count += len(run)
        if count > HELD_PAIRS:
            yield _shared_rows(held)
            held, count = [], 0
    if held:
        yield _shared_rows(held)


def _grouped(a: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row (a, lists) for each run of equal a."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    off = pa.array(np.append(first, len(a)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a[first]), *(pa.ListArray.from_arrays(off, pa.array(x)) for x in columns.values())], names=["a", *columns])


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, need, met) with each pair once: the least need, the summed met."""
    a, b, need, met = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, need, met = a[order], b[order], need[order], met[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.minimum.reduceat(need, first), np.minimum(np.add.reduceat(met.astype(np.int64), first), 100).astype(np.int8)


def _unsure(block: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, partners): the place of each entry by block and g, and how many of the first
    places make pairs with it that aren't known to be similar by their block and g."""
    order = np.lexsort((g, block))
    block, g = block[order], g[order]
    place = np.arange(len(g))
    start = np.searchsorted(block, block)
    less = np.zeros(len(g), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        if y - x > 1:
            less[x:y] = np.searchsorted(g[x:y], -g[x:y])
    return order, start + np.minimum(less, place - start)


def _pairs(t: float, long: int = 0):
    """From lists: (a, [b], [need and met]), each pair once for each time that memory is
    emptied. With long, rows without places come before the lists of their lead, with the
    pivots of its sets; lists of at least so many sets leave out what those show."""

    def short_ones(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        count, total = (np.asarray(pa.compute.list_value_length(batch.column(c))).astype(np.int64) for c in ("sids", "places"))
        sid, n, pos = (np.asarray(batch.column(c).flatten()) for c in ("sids", "sizes", "places"))
        # the sets of a row repeat for each of its lists
        place = (np.arange(len(pos)) - np.repeat(np.cumsum(total) - total, total)) % np.repeat(count, total)
        spot = np.repeat(np.cumsum(count) - count, total) + place
        sid, n = sid[spot], n[spot]
        after = np.repeat(count, total) - place - 1  # entries that follow in the list
        live = np.flatnonzero(after >= 1)
        step = 1
        while len(live):
            for x in range(0, len(live), HELD_PAIRS):
                i = live[x : x + HELD_PAIRS]
                yield sid, n, pos, i, i + step
            step += 1
            live = live[after[live] >= step]

    def long_ones(batch: pa.RecordBatch, known: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        leads, at = np.asarray(batch.column("lead")), None
        for r in range(batch.num_rows):
            sid, n, places = (np.asarray(batch.column(c)[r].values) for c in ("sids", "sizes", "places"))
            if at is None or leads[r] != leads[r - 1]:
                at = slice(int(np.searchsorted(known[0], leads[r])), int(np.searchsorted(known[0], leads[r], side="right")))
                by = np.argsort(known[1][at])
                ids, pivots, gs = (k[at][by] for k in known[1:])
                pivots = np.unique(pivots, return_inverse=True)[1]
            block, g = len(ids) + np.arange(len(sid)), np.zeros(len(sid))
            if len(ids):
                spot = np.minimum(np.searchsorted(ids, sid), len(ids) - 1)
                on = ids[spot] == sid
                block[on], g[on] = pivots[spot[on]], gs[spot[on]]
            order, partners = _unsure(block, g)
            upto = np.cumsum(partners)
            x = 0
            while x < len(order):
                y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + HELD_PAIRS, side="right")))
                k = partners[x:y]
                i = np.repeat(order[x:y], k)
                j = order[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
                i, j = np.minimum(i, j), np.maximum(i, j)
                if len(i):
                    for pos in places.reshape(-1, len(sid)):
                        yield sid, n, pos, i, j
                x = y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        known = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, need, met = _counted(held)
            for x in range(0, len(a), 1 << 18):
                y = slice(x, x + (1 << 18))
                # met in units of 4, need (at most SUBSET) below
                yield _grouped(a[y], {"b": b[y], "code": (np.minimum(met[y], 24) * 4 + need[y]).astype(np.int8)})

        def meetings(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal known
            if not long:
                yield from short_ones(batch)
                return
            some = np.asarray(pa.compute.list_value_length(batch.column("places"))) > 0
            large = np.asarray(pa.compute.list_value_length(batch.column("sids"))) >= long
            told = batch.filter(pa.array(~some))
            known = tuple(np.concatenate([k, x]) for k, x in zip(known, (np.asarray(told.column("lead")), *(np.asarray(told.column(c).flatten()) for c in ("sids", "pivots", "gs"))), strict=True))
            yield from short_ones(batch.filter(pa.array(some & ~large)))
            yield from long_ones(batch.filter(pa.array(some & large)), known)
            if batch.num_rows:
                last = int(np.searchsorted(known[0], batch.column("lead")[-1].as_py()))
                known = tuple(k[last:] for k in known)

        for batch in batches:
            for sid, n, pos, i, j in meetings(batch):
                side_i, side_j, n_i, n_j = n[i] >> 29, n[j] >> 29, n[i] & _SIZE, n[j] & _SIZE
                ok, need = _met(n_i, n_j, pos[i], pos[j], t)
                ok &= (side_i < 2) | (side_i != side_j)  # sets of one side meet in another list
                i, j = i[ok], j[ok]
                need = np.where(pos[i] == 0x7FFFFFFF, 1, np.minimum(SUBSET, np.ceil(need[ok]))).astype(np.int8)
                held.append((sid[i], sid[j], need, np.ones(len(i), np.int8)))
                size += len(i)
                if size > HELD_PAIRS:
                    held = [_counted(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, [b], [need and met]) sorted by a: (a, [b]) of the pairs that met often enough."""
    for batch in whole_runs(batches, "a"):
        count = np.asarray(pa.compute.list_value_length(batch.column("b")))
        a = np.repeat(np.asarray(batch.column("a")), count)
        b, code = (np.asarray(batch.column(c).flatten()) for c in ("b", "code"))
        a, b, need, met = _counted([(a, b, code & 3, code >> 2)])
        ok = met >= need
        yield _grouped(a[ok], {"b": b[ok]})


def _bit(doc_id: np.ndarray, m: int) -> np.ndarray:
    return textvec.mix(doc_id.view(np.uint64)) & np.uint64(m - 1)


def _bits(m: int):
    """Bits of a task's doc_ids, in non-empty chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_bit(np.asarray(b.column("doc_id")), m) for b in batches]
        bits = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        chunk = (bits >> np.uint64(17)).astype(np.int64)
        for c in np.unique(chunk):
            field = np.zeros(1 << 17, np.uint8)
            field[(bits[chunk == c] & np.uint64((1 << 17) - 1)).astype(np.int64)] = 1
            blob = pa.compress(np.packbits(field).tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "counts"])

    return run


def _or_up(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << 14, np.uint8)
    for blob in table.column("counts").to_pylist():
        total |= np.frombuffer(pa.decompress(blob, 1 << 14, "zstd", asbytes=True), np.uint8)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _packed(h: np.ndarray) -> bytes:
    """48 bits of each of the sorted hashes, as differences by byte planes."""
    steps = np.diff(h >> np.uint64(16), prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 6 * n, "zstd", asbytes=True), np.uint8).reshape(6, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel())


def _wanted(n: int, bits):
    """(sid, set) of the texts whose doc_id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = bits.value
        for batch in batches:
            b = _bit(np.asarray(batch.column("doc_id")), len(field) * 8)
            hit = (field[(b >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (b & np.uint64(7)).astype(np.uint8))) & 1
            for part in textvec.slices(batch.filter(pa.array(hit == 1)), "text"):
                h, doc = _sets(part.column("text"), n)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sid, size = _set_ids(h, first), np.diff(first)
                some = np.flatnonzero(size > 0)
                blobs = [_packed(h[first[i] : first[i + 1]]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(size[some].astype(np.int32)), pa.array(blobs, pa.binary())], names=["sid", "size", "grams"])

    return run


def _sets_of(texts: DataFrame, members: DataFrame, sids: DataFrame, expected: int, n: int) -> DataFrame:
    """(sid, size, grams) of at least the sids, each once."""
    bits = 1 << 17
    while bits < min(FILTER_BITS, 16 * expected):
        bits *= 2
    # one document of each set brings it
    ends = sids.join(members.groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "sid")
    field = np.zeros(bits // 8, np.uint8)
    for row in ends.mapInArrow(_bits(bits), "chunk int, counts binary").groupBy("chunk").applyInArrow(_or_up, "chunk int, counts binary").collect():
        field[row.chunk << 14 : (row.chunk + 1) << 14] = np.frombuffer(row.counts, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(field)
    return texts.mapInArrow(_wanted(n, shared), "sid long, size int, grams binary").repartition("sid").dropDuplicates(["sid"])


def _near(t: float):
    """(sid, pivot, g) of the sets that are similar to their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            for row in batch.to_pylist():
                if row["pivot"] != last:
                    last, pivot = row["pivot"], _unpacked(row["of_pivot"], row["most"])
                x = _unpacked(row["grams"], row["size"])
                both = int((pivot[np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)] == x).sum())
                if both >= t * (len(x) + len(pivot) - both) - 1e-9:
                    found.append((row["sid"], last, (1 + t) * both - t * len(x) - (1 + t) / 2 * len(pivot)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["sid", "pivot", "g"])

    return run


def _cores(texts: DataFrame, members: DataFrame, lists: DataFrame, t: float, n: int) -> tuple[DataFrame, DataFrame] | None:
    """(core, told): core(sid, pivot, g) has the sets that are similar to a pivot, told the
    rows that go with the lists of each lead. None without long lists."""
    entries = lists.filter(F.size("sids") >= LONG).select("lead", F.explode("sids").alias("sid"), (F.size("places") / F.size("sids")).cast("long").alias("k"))
    met = entries.groupBy("lead", "sid").agg(F.sum("k").alias("k"))
    several = members.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1")
    if several.limit(1).count():
        met = met.join(several.join(members, "doc_id").select("sid").distinct(), "sid", "left_anti")
    met = scratch.save(met, "ngram-met")
    if not met.limit(1).count():
        return None
    copies = members.join(met.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("copies"))
    chosen = met.join(copies, "sid").groupBy("lead").agg(F.max(F.struct("k", "copies", "sid")).alias("top"), F.count("*").alias("sets")).select("lead", F.col("top.sid").alias("pivot"), "sets")
    given = met.join(chosen, "lead").groupBy("sid").agg(F.max(F.struct("sets", "pivot")).alias("top")).select("sid", F.col("top.pivot").alias("pivot"))
    given = scratch.save(given, "ngram-given")
    wanted = given.select("sid").unionAll(given.select("pivot")).distinct()
    sets = scratch.save(_sets_of(texts, members, wanted, given.count(), n).join(wanted, "sid", "left_semi"), "ngram-given-sets")
    pivots = sets.join(given.select("pivot").distinct(), sets.sid == F.col("pivot"), "left_semi").select(F.col("sid").alias("pivot"), F.col("size").alias("most"), F.col("grams").alias("of_pivot"))
    pairs = sets.join(given, "sid").join(pivots, "pivot").select("sid", "pivot", "size", "grams", "most", "of_pivot")
    core = scratch.save(pairs.mapInArrow(_near(t), "sid long, pivot long, g double"), "ngram-core")
    told = met.join(core, "sid").select("lead", F.array("sid").alias("sids"), F.array().cast("array<int>").alias("sizes"), F.array().cast("array<int>").alias("places"), F.array("pivot").alias("pivots"), F.array("g").alias("gs"))
    return core, told


def _core_links(group: pa.Table) -> pa.Table:
    """(sid, m): in how many documents the sets of one core are that each is known to be similar to, but its own."""
    g, m = np.asarray(group.column("g")), np.asarray(group.column("copies"))
    order = np.argsort(g)
    upto = np.concatenate([[0], np.cumsum(m[order])])
    total = upto[-1] - upto[np.searchsorted(g[order], -g)] - np.where(g >= 0, m, 0)
    return pa.table({"sid": group.column("sid"), "m": pa.array(total.astype(np.int64))})


def _verify(t: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(sets.column("sid")), kind="stable")
        sid, size = (np.asarray(sets.column(c))[order] for c in ("sid", "size"))
        blobs = sets.column("grams").to_pylist()
        grams = [_unpacked(blobs[i], n) for i, n in zip(order.tolist(), size.tolist(), strict=True)]
        flat = np.unique(np.concatenate(grams), return_inverse=True)[1] if grams else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        # (set, n-gram) as one sorted number
        owned = (np.repeat(np.arange(len(sid)), size) << 32) | flat
        partners = pairs.column("b").combine_chunks()
        b = np.searchsorted(sid, np.asarray(partners.flatten()))
        a = np.searchsorted(sid, np.repeat(np.asarray(pairs.column("a")), np.asarray(pa.compute.list_value_length(partners))))
        swap = size[a] > size[b]
        x, y = np.where(swap, b, a), np.where(swap, a, b)
        both = np.zeros(len(a), np.int64)
        total = np.concatenate([[0], np.cumsum(size[x], dtype=np.int64)])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), side="right")) - 1)
            n = size[x[at:to]].astype(np.int64)
            pair = np.repeat(np.arange(at, to), n)
            asked = (y[pair] << 32) | flat[first[x[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            spot = np.minimum(np.searchsorted(owned, asked), len(owned) - 1)
            both[at:to] = np.bincount(pair - at, weights=owned[spot] == asked, minlength=to - at)
            at = to
        union = size[a].astype(np.int64) + size[b] - both
        pivot, g = (np.asarray(sets.column(c))[order] for c in ("pivot", "g"))
        ok = (both >= t * union - 1e-9) & ((pivot[a] != pivot[b]) | (g[a] + g[b] < 0))
        a, b = a[ok], b[ok]
        copies = np.asarray(sets.column("copies"))[order]
        return pa.table({"a": sid[a], "b": sid[b], "jaccard": both[ok] / union[ok], "of_a": copies[a], "of_b": copies[b], "joins": _joining(a.tolist(), b.tolist(), len(sid))})

    return run


def _joining(a: list[int], b: list[int], n: int) -> np.ndarray:
    """Which of the pairs, in order, join two groups that the pairs before didn't: as many as connect all."""
    root = list(range(n))

    def of(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joins = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = of(x), of(y)
        if x != y:
            root[y] = x
            joins[i] = True
    return joins


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(doc_id, sid) maps documents to their n-gram sets,
    pairs(a, b, jaccard, of_a, of_b, joins) are the similar distinct sets, a < b, with the
    numbers of their documents; the pairs that join connect all that the pairs connect."""
    return _search(docs, threshold, n, False)[:2]


def _search(docs: DataFrame, threshold: float, n: int, cores: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members, pairs, core): with cores, the pairs are those that no core shows."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    scan = scratch.save(texts.mapInArrow(_scan(n, ORDER_BUCKETS), "doc_id long, sid long, n int, chunk int, counts binary"), "ngram-scan")
    members = scan.filter("chunk is null and n > 0").select("doc_id", "sid")

    summed = scan.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_add_up(_CHUNK), "chunk int, counts binary")
    counts = np.zeros(ORDER_BUCKETS, np.uint32)
    for row in summed.collect():  # ORDER_BUCKETS counters at any size
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.uint32)
    by_size = scan.filter("chunk is null and n > 0").groupBy("n").count()
    # one number a set size up to 10,000; larger sets are never light
    sizes = {r.n: r["count"] for r in by_size.filter("n <= 10000").collect()}
    light = boundary(sizes, threshold, _probe_length(counts, threshold))
    order = sc.broadcast(counts)

    rows = texts.select("text").mapInArrow(_postings(n, threshold, light, order, HOT), "key long, sid long, at long")
    lists = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _lists(batches, threshold), "lead long, sids array<long>, sizes array<int>, places array<int>")
    lists = scratch.save(lists, "ngram-lists")
    members = members.distinct()
    core = None
    if cores and (found := _cores(texts, members, lists, threshold, n)):
        core, told = found
        lists = lists.withColumns({"pivots": F.array().cast("array<long>"), "gs": F.array().cast("array<double>")}).unionByName(told).withColumn("kind", F.size("places") > 0)
        met = lists.repartition("lead").sortWithinPartitions("lead", "kind").mapInArrow(_pairs(threshold, LONG), "a long, b array<long>, code array<tinyint>")
    else:
        met = lists.repartition("lead").sortWithinPartitions("lead").mapInArrow(_pairs(threshold), "a long, b array<long>, code array<tinyint>")
    pairs = met.repartition("a").sortWithinPartitions("a").mapInArrow(_candidates, "a long, b array<long>")
    pairs = scratch.save(pairs, "ngram-candidates")

    total = pairs.agg(F.coalesce(F.sum(F.size("b")), F.lit(0)).alias("k")).collect()[0].k
    ends = pairs.select(F.explode(F.concat(F.array("a"), "b")).alias("sid")).distinct()

    # the cell of a pair is a label of its first set that, in groups of similar sets,
    # nearly all have in common: the least first partner of its partners, and so on
    edges = pairs.select("a", F.explode("b").alias("x"))
    least = edges.groupBy("x").agg(F.min("a").alias("first"))
    first = edges.join(least, "x").groupBy(F.col("a").alias("x")).agg(F.min("first").alias("first"))
    first = scratch.save(least.join(first.withColumnRenamed("first", "other"), "x", "full").select("x", F.least("first", "other").alias("first")), "ngram-first")
    for _ in range(2):
        again = first.select(F.col("x").alias("x0"), F.col("first").alias("first0"))
        first = scratch.save(first.join(again, F.col("first") == F.col("x0"), "left").select("x", F.least("first0", "first").alias("first")), "ngram-first")
    placed = pairs.join(first, pairs.a == first.x, "left").select(F.coalesce("first", "a").alias("cell"), "a", "b")
    grid = placed.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.sqrt(F.sum(F.size("b")) / CELL_PAIRS)).cast("long").alias("g")).filter("g > 1")
    # cells to be cut have more than CELL_PAIRS pairs each, so they are few beside the pairs
    placed = placed.join(grid, F.col("cell") == F.col("c"), "left").withColumn("g", F.coalesce("g", F.lit(1)))
    side = F.when(F.col("g") > 1, F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda k: F.struct(k.alias("k"), F.filter("b", lambda q: F.pmod(F.xxhash64(q, F.lit(1)), F.col("g")) == k).alias("b")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("k"), F.col("b").alias("b")))
    )
    placed = placed.select("cell", "a", F.when(F.col("g") > 1, F.pmod(F.xxhash64("a"), "g")).otherwise(0).alias("h"), F.explode(side).alias("s")).filter("size(s.b) > 0")
    groups_of_cells = max(64, -(-total // GROUP_PAIRS))
    placed = placed.select(F.pmod(F.xxhash64("cell", "h", "s.k"), F.lit(groups_of_cells)).alias("cell"), "a", F.col("s.b").alias("b"))
    placed = scratch.save(placed, "ngram-cells")
    needed = placed.select(F.col("cell").alias("spot"), F.explode(F.concat(F.array("a"), "b")).alias("sid")).distinct()
    sets = _sets_of(texts, members, ends, 2 * total, n)
    sets = sets.join(members.groupBy("sid").agg(F.count("*").alias("copies")), "sid")
    if core is None:
        sets = sets.withColumns({"pivot": F.col("sid"), "g": F.lit(-math.inf)})
    else:
        sets = sets.join(core, "sid", "left").withColumns({"pivot": F.coalesce("pivot", "sid"), "g": F.coalesce("g", F.lit(-math.inf))})
    sets = needed.join(sets.hint("merge"), "sid").select("spot", "sid", "size", "copies", "grams", "pivot", "g")
    checked = placed.groupBy("cell").cogroup(sets.groupBy("spot")).applyInArrow(_verify(threshold), "a long, b long, jaccard double, of_a long, of_b long, joins boolean")
    return members, checked, core


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of documents at or above the threshold, doc_a < doc_b."""
    members, pairs = similar_sets(docs, threshold, n)
    pairs = scratch.save(pairs, "ngram-pairs")
    x = members.select(F.col("sid").alias("a"), F.col("doc_id").alias("x"))
    y = members.select(F.col("sid").alias("b"), F.col("doc_id").alias("y"))
    near = pairs.join(x, "a").join(y, "b").select("x", "y", "jaccard")
    same = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("jaccard"))
    both = near.unionAll(same).filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    if members.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # only a document of several texts can meet another more than once
        both = both.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return both


def groups(members: DataFrame, pairs: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id): connected groups of similar documents; group_id is the
    smallest doc_id of the group. Documents that are in no pair and share no set are
    groups of one. Labels spread from neighbours and then from the label's own label,
    so long chains take a number of rounds that is logarithmic in their length."""
    own = members.groupBy("sid").agg(F.min("doc_id").alias("label"))
    # a doc_id with several texts links their sets
    shared = members.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z"), F.count("*").alias("k")).filter("k > 1")
    extra = shared.join(members, "doc_id").select("a", F.col("sid").alias("b")).filter("a <> b")
    edges = pairs.filter("joins").select("a", "b").unionAll(extra)
    if core is not None:
        edges = edges.unionAll(core.filter("sid <> pivot").select("pivot", "sid"))
    edges = scratch.save(edges.unionAll(edges.select("b", "a")).distinct(), "group-edges")
    touched = edges.select(F.col("a").alias("sid")).distinct()
    now = scratch.save(own.join(touched, "sid", "left_semi").withColumn("changed", F.lit(True)), "group-labels")
    while now.filter("changed").limit(1).count():
        heard = edges.join(now.filter("changed").select(F.col("sid").alias("b"), F.col("label").alias("said")), "b").groupBy(F.col("a").alias("sid")).agg(F.min("said").alias("said"))
        step = now.join(heard, "sid", "left").select("sid", F.col("label").alias("was"), F.least("label", "said").alias("label"))
        # the set that owns a label knows the smallest label seen by then
        root = step.groupBy(F.col("was").alias("label0")).agg(F.min("label").alias("best"))
        step = step.join(root, F.col("was") == F.col("label0"), "left").select("sid", F.least("label", "best").alias("label"), (F.least("label", "best") < F.col("was")).alias("changed"))
        now = scratch.save(step, "group-labels")
    label = own.join(now.select("sid", F.col("label").alias("to")), "sid", "left").select("sid", F.coalesce("to", "label").alias("label"))
    return members.join(label, "sid").groupBy("doc_id").agg(F.min("label").alias("group_id"))


def _links(members: DataFrame, pairs: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """(doc_id, links): how many other documents each document with words is similar to."""
    weight = members.groupBy("sid").agg(F.count("*").alias("m"))
    near = pairs.select(F.col("a").alias("sid"), F.col("of_b").alias("m")).unionAll(pairs.select(F.col("b").alias("sid"), F.col("of_a").alias("m"))).unionAll(weight)
    if core is not None:
        near = near.unionAll(core.join(weight.withColumnRenamed("m", "copies"), "sid").groupBy("pivot").applyInArrow(_core_links, "sid long, m long"))
    total = near.groupBy("sid").agg(F.sum("m").alias("total"))
    texts = members.groupBy("doc_id").agg(F.count("*").alias("k"))
    links = members.join(total, "sid").select("doc_id", (F.col("total") - 1).alias("links"))
    if not texts.filter("k > 1").limit(1).count():
        return links
    # documents of several texts count once where more than one of their sets is near
    several = scratch.save(texts.filter("k > 1").select("doc_id").join(members, "doc_id"), "ngram-several")
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(weight.select(F.col("sid").alias("a"), F.col("sid").alias("b")))
    again = several.join(both, F.col("sid") == F.col("b")).groupBy("a", "doc_id").agg((F.count("*") - 1).alias("over")).groupBy(F.col("a").alias("sid")).agg(F.sum("over").alias("over"))
    one = members.join(several.select("doc_id").distinct(), "doc_id", "left_anti").join(total, "sid").join(again, "sid", "left")
    one = one.select("doc_id", (F.col("total") - 1 - F.coalesce("over", F.lit(0))).alias("links"))
    reached = several.join(both, F.col("sid") == F.col("a")).select(F.col("doc_id").alias("x"), "b").distinct().join(members, F.col("b") == F.col("sid")).select("x", "doc_id").distinct()
    return one.unionAll(reached.groupBy(F.col("x").alias("doc_id")).agg((F.count("*") - 1).alias("links")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, links), one row a doc_id: class_id is the smallest doc_id of the
    documents connected by similar pairs, links the number of documents similar to this one."""
    members, pairs, core = _search(docs, threshold, n, True)
    members, pairs = scratch.save(members, "ngram-members"), scratch.save(pairs, "ngram-pairs")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    found = groups(members, pairs, core).select("doc_id", F.col("group_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    rows = found.unionAll(_links(members, pairs, core).select("doc_id", F.lit(None).cast("long"), "links")).unionAll(ids.select("doc_id", F.lit(None).cast("long"), F.lit(0).cast("long")))
    rows = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of docs without those of a doc_id that isn't the smallest of its group.
    Rows without doc_id, or whose texts have no words, stay; so do all rows of a doc_id."""
    members, pairs, core = _search(docs, threshold, n, True)
    members, pairs = scratch.save(members, "ngram-members"), scratch.save(pairs, "ngram-pairs")
    lost = groups(members, pairs, core).filter("doc_id <> group_id").select(F.col("doc_id").alias("lost_id"))
    return docs.join(lost, docs["doc_id"].cast("long") == lost["lost_id"], "left_anti")
