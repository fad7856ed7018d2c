"""A persistent, append-only full-text index.

An index is a folder of Parquet tables. Every addition is a batch with its documents,
postings and word statistics, and becomes visible as a whole when its commit file
appears; labels are batches of a log. Documents aren't changed or deleted, labels come
and go. All readers see the batches that were committed when they asked.

    docs/batch=B       doc_id and the stored columns, one row a document
    postings/batch=B   field, word, doc_id, positions, by field, word and falling doc_id from file to file
    stats/batch=B      field, word, df, occurrences
    labels/batch=B     op, label, doc_id
    label_stats/batch=B  label, df; of merged labels only
    commits/N          batch B, its tables, documents, least and largest doc_id, source
    ids/N              doc_ids given out to writers so far
    snapshots/N        all live commits up to N

Any number of writers may add at the same time: B is a name of a writer's own, and the
numbers N of commits and of given ids are claimed by a rename that fails if the number
is taken; the writer then looks at what came in between and tries the next one. What a
writer that failed has left behind is listed nowhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.tokens import MAX_TOKEN_BYTES, local_tokens
from ..plans.ast import Label, Not, Query, Term
from ..plans.parser import parse
from ..plans.planner import plan
from . import labels as label_ops
from . import postings as post

STATS = "field string, word string, df long, occurrences long"
VERSION = 2
#: Every so many commits are listed in a snapshot.
SNAPSHOT = 64
#: Ids that the first step of a limited search goes down.
FIRST_STEP = 4096
#: Results of 2^PLACE_BITS ids that follow each other are numbered by one task.
PLACE_BITS = 16


class IndexStateError(RuntimeError):
    """The index is missing, exists already or can't take what it was given."""


class VersionError(IndexStateError):
    """The index was written by another version."""


@dataclass
class Entry:
    """A document that is being put together; positions go on from one addition to the next."""

    tokens: list[tuple[str, str]] = field(default_factory=list)

    def add_string(self, field: str, text: str) -> Entry:
        self.tokens += [(field, t) for t in local_tokens(text) if len(t.encode()) <= MAX_TOKEN_BYTES]
        return self

    def add_token(self, field: str, word: str) -> Entry:
        """One word as it is, of any length."""
        self.tokens.append((field, word))
        return self

    def add_file(self, field: str, path: str) -> Entry:
        with open(path, encoding="utf-8", errors="replace") as f:
            return self.add_string(field, f.read())

    def __len__(self) -> int:
        return len(self.tokens)


class Cursor:
    """Pages through the results of a query, newest first, over the documents that there were at the start."""

    def __init__(self, index: Index, query: Query):
        self.index, self.query = index, query
        self.batches = index._commits()
        self.last: int | None = None
        self.done = False

    def next(self, n: int) -> list[int]:
        """Up to n more ids; fewer mean that there are no more."""
        if self.done or n <= 0:
            return []
        ids = self.index._newest(self.query, self.batches, n, self.last)
        self.done = len(ids) < n
        if ids:
            self.last = ids[-1]
        return ids

    def rest(self) -> DataFrame:
        """(place, doc_id) of all results that are left, place 0 the newest of them; one query for all pages, and none of it in the driver. The cursor is at its end then."""
        found = self.index._find(self.query, self.batches if not self.done else [], self.last).withColumn("span", F.shiftright("doc_id", PLACE_BITS))
        self.done = True
        # a row for each span of ids that has results
        before = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
        starts = found.groupBy("span").agg(F.count("*").alias("n")).select(F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        within = F.row_number().over(Window.partitionBy("span").orderBy(F.desc("doc_id"))).cast("long")
        placed = found.select("span", "doc_id", within.alias("k")).join(F.broadcast(starts), F.col("span") == F.col("s"))
        return placed.select((F.col("start") + F.col("k") - 1).alias("place"), "doc_id")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = storage.Folder(spark, self.path)
        self._read: dict[str, dict] = {}  # commit files, which don't change

    # -- lifecycle

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return storage.Folder(spark, path).exists("meta.json")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Index:
        index = cls(spark, path)
        if not index.folder.publish("meta.json", json.dumps({"version": VERSION})):
            raise IndexStateError(f"there is an index at {path}")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        index = cls(spark, path)
        if not index.folder.exists("meta.json"):
            raise IndexStateError(f"there is no index at {path}")
        version = json.loads(index.folder.read("meta.json"))["version"]
        if version != VERSION:
            raise VersionError(f"the index has version {version}, this is {VERSION}")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index at path, created if there is none."""
        return cls.load(spark, path) if cls.exists(spark, path) else cls.create(spark, path)

    @classmethod
    def delete(cls, spark: SparkSession, path: str) -> None:
        storage.Folder(spark, path).delete()

    def close(self) -> None:
        """Nothing is held open; here for symmetry."""

    # -- tables

    def _numbers(self, name: str) -> list[str]:
        return [n for n in self.folder.names(name) if n.isdigit()]

    def _commits(self) -> list[dict]:
        """The live commits in order, each with its number as ``seq`` (a merged one with the largest that it replaces)."""
        snapshots = self._numbers("snapshots")
        name = f"snapshots/{snapshots[-1]}" if snapshots else ""
        if name and name not in self._read:
            self._read = {k: v for k, v in self._read.items() if k > f"commits/{snapshots[-1]}"} | {name: json.loads(self.folder.read(name))}
        commits = list(self._read[name]["commits"]) if name else []
        for n in self._numbers("commits"):
            if snapshots and n <= snapshots[-1]:
                continue
            at = f"commits/{n}"
            if at not in self._read:
                commit = json.loads(self.folder.read(at))
                self._read[at] = {"seq": int(n)} | commit | {"number": int(n)}
            commits.append(self._read[at])
        replaced = {b for c in commits for b in c.get("replaces", [])}
        return [c for c in commits if c["batch"] not in replaced]

    def _table(self, name: str, schema: str | None, commits: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={c['batch']}" for c in commits if name in c["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema or "doc_id long")
        if schema:
            return self.spark.read.schema(schema).parquet(*paths)
        # batches may differ in the columns that they store
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def _log_of(self, commits: list[dict]) -> DataFrame:
        """The label log (seq, op, label, doc_id)."""
        batches = [(c["batch"], c["seq"]) for c in commits if "labels" in c["tables"]]
        if not batches:
            return self.spark.createDataFrame([], label_ops.LOG)
        rows = self.spark.read.schema(f"{label_ops.STORED}, batch string").option("basePath", f"{self.path}/labels").parquet(*[f"{self.path}/labels/batch={b}" for b, _ in batches])
        if len(batches) == 1:
            return rows.select(F.lit(batches[0][1]).cast("long").alias("seq"), "op", "label", "doc_id")
        # a row a batch of labels, which optimize merges to one
        order = self.spark.createDataFrame(batches, "b string, seq long")
        return rows.join(F.broadcast(order), F.col("batch") == F.col("b")).select("seq", "op", "label", "doc_id")

    def docs(self) -> DataFrame:
        return self._table("docs", None, self._commits())

    def postings(self) -> DataFrame:
        return self._table("postings", post.POSTINGS, self._commits())

    def label_log(self) -> DataFrame:
        return self._log_of(self._commits())

    def labels(self) -> DataFrame:
        return label_ops.current(self.label_log())

    def term_stats(self) -> DataFrame:
        """(field, word, df, occurrences) over all batches."""
        stats = self._table("stats", STATS, self._commits())
        return stats.groupBy("field", "word").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))

    def label_stats(self) -> DataFrame:
        """(label, df) of the labels that documents carry now."""
        logs = [c for c in self._commits() if "labels" in c["tables"]]
        if len(logs) == 1 and "label_stats" in logs[0]["tables"]:
            return self._table("label_stats", "label string, df long", logs)
        return label_ops.label_counts(label_ops.current(self._log_of(logs)))

    def stats(self) -> DataFrame:
        """One row on the index as a whole."""
        commits = self._commits()
        sums = self.term_stats().agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
        about = [F.lit(sum(c["docs"] for c in commits)).alias("docs"), F.lit(len(commits)).alias("batches"), F.lit(self.folder.size("postings")).alias("postings_bytes"), F.lit(VERSION).alias("version")]
        return sums.select(*about, "*")

    def dump(self) -> DataFrame:
        """All postings by field, word and falling doc_id. Those of one batch lie so in its files, which are read one after the other; those of several are sorted."""
        commits = [c for c in self._commits() if "postings" in c["tables"]]
        if len(commits) != 1 or not commits[0].get("ordered"):
            return self._table("postings", post.POSTINGS, commits).orderBy("field", "word", F.desc("doc_id"))
        at = f"postings/batch={commits[0]['batch']}"
        names = [n for n in self.folder.names(at) if n.endswith(".parquet")]
        # a scan of several files takes the largest first
        return post.union([self.spark.read.schema(post.POSTINGS).parquet(f"{self.path}/{at}/{n}") for n in names]) if names else self._table("postings", post.POSTINGS, [])

    # -- writing

    def _claim(self, name: str, make) -> tuple[int, dict]:
        """Publishes make(previous number) under the next free number; make is asked again if another writer took it."""
        while True:
            last = int(max(self._numbers(name) + (self._numbers("snapshots") if name == "commits" else []), default="0"))
            text = make(last)
            if text is None or self.folder.publish(f"{name}/{last + 1:010d}", json.dumps(text)):
                return last + 1, text

    def _commit(self, commit: dict, check=None) -> dict | None:
        """Makes a batch visible; None if its source is committed already. ``check`` is called with the commits that came after those it has seen."""
        seen: set[str] = set()

        def make(_: int) -> dict | None:
            now = self._commits()
            if commit.get("source") is not None and any(commit["source"] in (c.get("source"), *c.get("sources", [])) for c in now):
                return None
            gone = set(commit.get("replaces", [])) - {c["batch"] for c in now}
            if gone:
                raise IndexStateError("another writer merged these batches")
            if check:
                check([c for c in now if c["batch"] not in seen])
                seen.update(c["batch"] for c in now)
            return commit

        number, done = self._claim("commits", make)
        if done is not None and number % SNAPSHOT == 0:
            self._snapshot()
        return done

    def _snapshot(self) -> str:
        """Lists all live commits in one file, so that readers open it and what came later."""
        commits = self._commits()
        name = f"{max((c['number'] for c in commits), default=0):010d}"
        self.folder.publish(f"snapshots/{name}", json.dumps({"commits": commits}))
        return name

    def _done(self, source: str | None) -> bool:
        return source is not None and any(source in (c.get("source"), *c.get("sources", [])) for c in self._commits())

    def _reserve(self, n: int) -> int:
        """The first of n doc_ids, larger than all known, that no other writer gets."""

        def make(last: int) -> dict:
            given = json.loads(self.folder.read(f"ids/{last:010d}"))["last"] if last else 0
            return {"last": max(given, self._last_id()) + n}

        return self._claim("ids", make)[1]["last"] - n + 1

    def _numbered(self, rows: DataFrame, scratch: str) -> DataFrame:
        """rows with new doc_ids in their order, without moving them to one task."""
        rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{scratch}")
        staged = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType())])).parquet(f"{self.path}/{scratch}")
        part = F.shiftright("_place", 33)
        # a row for each task that wrote
        counts = sorted((r.p, r.n) for r in staged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        offsets, at = [], self._reserve(sum(n for _, n in counts))
        for p, n in counts:
            offsets.append((p, at))
            at += n
        table = self.spark.createDataFrame(offsets, "_part long, _offset long")
        numbered = staged.join(F.broadcast(table), part == F.col("_part")).withColumn("doc_id", F.col("_offset") + F.col("_place").bitwiseAND((1 << 33) - 1))
        return numbered.drop("_place", "_part", "_offset")

    def _new_ids(self, batch: str, least: int | None, most: int | None):
        """A check that no batch of some commits has a doc_id of this batch; reads only batches whose range of ids overlaps."""

        def check(commits: list[dict]) -> None:
            near = [c for c in commits if c["docs"] and least is not None and c["min_doc_id"] <= most and c["max_doc_id"] >= least]
            if near:
                own = self.spark.read.schema("doc_id long").parquet(f"{self.path}/docs/batch={batch}")
                known = self._table("docs", "doc_id long", near).filter(F.col("doc_id").between(least, most))
                again = own.join(known, "doc_id", "left_semi").limit(1).collect()
                if again:
                    raise IndexStateError(f"there is a document {again[0].doc_id} already")

        return check

    def _add(self, documents: DataFrame, blocks: DataFrame, source: str | None = None, files: int | None = None) -> dict | None:
        """Commits documents(doc_id, stored columns...) and blocks of their postings as a batch; None if the source was committed before."""
        if self._done(source):
            return None  # a repeated micro-batch
        batch = uuid.uuid4().hex
        at = {t: f"{self.path}/{t}/batch={batch}" for t in ("docs", "postings", "stats")}
        staged = f"staging/postings-{batch}"
        rule = "spark.sql.optimizer.excludedRules"
        before = self.spark.conf.get(rule, None)
        self.spark.conf.set(rule, ",".join(filter(None, [before, post.NO_REPEAT])))
        try:
            # two jobs at a time: most of a small batch is waiting for single tasks
            with ThreadPoolExecutor(1) as beside:
                # kept unordered first, so that sampling the ranges doesn't tokenise once more
                staging = beside.submit(blocks.write.parquet, f"{self.path}/{staged}")
                documents.write.parquet(at["docs"])
                n, ids, least, most = self.spark.read.schema("doc_id long").parquet(at["docs"]).agg(F.count("*"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")).collect()[0]
                if n > ids:
                    raise IndexStateError("a doc_id is repeated")
                check = self._new_ids(batch, least, most)
                check(self._commits())
                staging.result()
                rows = self.spark.read.schema(post.BLOCKS).parquet(f"{self.path}/{staged}")
                counting = beside.submit(post.block_stats(rows).write.parquet, at["stats"])
                post.clustered(rows, files or self._tasks(staged)).write.parquet(at["postings"])
                counting.result()
            done = self._commit({"batch": batch, "tables": list(at), "docs": n, "min_doc_id": least, "max_doc_id": most, "source": source, "ordered": True}, check)
        except BaseException:
            done = None
            raise
        finally:
            self.spark.conf.set(rule, before) if before is not None else self.spark.conf.unset(rule)
            self.folder.delete(staged)
            if done is None:  # not listed anywhere
                for t in at:
                    self.folder.delete(f"{t}/batch={batch}")
        return done

    def _tasks(self, *names: str) -> int:
        return post.tasks_for(sum(map(self.folder.size, names)), self.spark.sparkContext.defaultParallelism)

    def _last_id(self) -> int:
        return max((c["max_doc_id"] for c in self._commits() if c["max_doc_id"] is not None), default=0)

    def _add_rows(self, rows: DataFrame, fields: dict[str, str], stored: list[str] | None, source: str | None, files: int | None) -> dict | None:
        stored = [c for c in (stored or []) if c != "doc_id"]
        wanted = dict.fromkeys([*stored, *fields.values()])
        staging = None
        if self._done(source):
            return None
        if "doc_id" in rows.columns:
            rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in wanted if c != "doc_id"]).filter("doc_id is not null")
        else:
            staging = f"staging/rows-{uuid.uuid4().hex}"
            rows = self._numbered(rows.select(*wanted), staging)
        rows = storage.spread(rows)
        try:
            return self._add(rows.select("doc_id", *stored), post.text_blocks(rows, fields), source, files)
        finally:
            if staging:
                self.folder.delete(staging)

    def add_documents(self, rows: DataFrame, fields: dict[str, str], stored: list[str] | None = None, source: str | None = None, files: int | None = None) -> int:
        """Adds a row a document; ``fields`` maps field names to the columns of their texts, in the order of positions.

        A doc_id column holds the ids, which must be new and distinct (rows without one are
        left out); without the column they are given out from the largest known on.
        ``stored`` columns are kept in the table of documents. The number of documents added.
        """
        done = self._add_rows(rows, fields, stored, source, files)
        return done["docs"] if done else 0

    def add_entries(self, entries: DataFrame) -> int:
        """Adds documents from rows (doc_id, seq, field, text)."""
        documents = post.entry_tokens(entries)
        return self._add(documents.select("doc_id"), post.blocks(post.build(documents)))["docs"]

    def add_entry(self, entry: Entry) -> int:
        """Adds one document and returns its id."""
        doc_id = self._reserve(1)
        documents = self.spark.createDataFrame([(doc_id, entry.tokens)], f"doc_id long, tokens {post.TOKEN}").coalesce(1)
        self._add(documents.select("doc_id"), post.blocks(post.build(documents)), files=1)
        return doc_id

    def _log(self, operations: DataFrame, source: str | None = None) -> dict | None:
        """Appends (op, label, doc_id); all of one call count as simultaneous, so a label and document must not be in it twice with different ops."""
        if self._done(source):
            return None
        batch = uuid.uuid4().hex
        operations.select("op", "label", F.col("doc_id").cast("long").alias("doc_id")).sortWithinPartitions("label", "doc_id").write.parquet(f"{self.path}/labels/batch={batch}")
        return self._commit({"batch": batch, "tables": ["labels"], "docs": 0, "min_doc_id": None, "max_doc_id": None, "source": source})

    def _known(self, pairs: DataFrame) -> None:
        unknown = pairs.select("doc_id").distinct().join(self._table("docs", "doc_id long", self._commits()), "doc_id", "left_anti").limit(1).collect()
        if unknown:
            raise IndexStateError(f"there is no document {unknown[0].doc_id}")

    def add_labels(self, pairs: DataFrame) -> None:
        """Labels documents from rows (label, doc_id)."""
        self._known(pairs)
        self._log(pairs.select(F.lit(label_ops.ADD).alias("op"), "label", "doc_id").distinct())

    def remove_labels(self, pairs: DataFrame) -> None:
        self._log(pairs.select(F.lit(label_ops.REMOVE).alias("op"), "label", "doc_id").distinct())

    def apply_labels(self, operations: DataFrame, source: str | None = None) -> None:
        """Appends rows (op, label, doc_id[, seq]): of one label and document the largest seq counts, and a
        removal before an addition of the same (or of none). Additions to unknown documents are refused."""
        if self._done(source):
            return
        valid = operations.filter(F.col("op").isin(label_ops.ADD, label_ops.REMOVE))
        order = F.struct(F.col("seq") if "seq" in operations.columns else F.lit(0).alias("seq"), "op")
        last = valid.groupBy("label", "doc_id").agg(F.max_by("op", order).alias("op"))
        self._known(last.filter(F.col("op") == label_ops.ADD))
        self._log(last, source)

    def _pair(self, doc_id: int, label: str) -> DataFrame:
        return self.spark.createDataFrame([(label, doc_id)], "label string, doc_id long").coalesce(1)

    def add_label(self, doc_id: int, label: str) -> None:
        self.add_labels(self._pair(doc_id, label))

    def remove_label(self, doc_id: int, label: str) -> None:
        """Takes a label away; no label, no document: nothing happens."""
        self.remove_labels(self._pair(doc_id, label))

    def set_labels(self, doc_id: int, labels: set[str]) -> None:
        """Makes these the labels of a document."""
        want = self.spark.createDataFrame([(name, doc_id) for name in sorted(labels)], "label string, doc_id long")
        self._known(self._pair(doc_id, ""))
        self._log(label_ops.changes(self.labels().filter(F.col("doc_id") == doc_id), want))

    # -- queries

    def _query(self, query: Query | str, default_field: str) -> Query:
        return parse(query, default_field) if isinstance(query, str) else query

    def _find(self, query: Query, commits: list[dict], before: int | None = None, after: int | None = None) -> DataFrame:
        """Matches with doc_ids below ``before`` and above ``after``; batches beyond them aren't read."""
        commits = [c for c in commits if c["max_doc_id"] is not None and (before is None or c["min_doc_id"] < before) and (after is None or c["max_doc_id"] > after)]
        docs = self._table("docs", "doc_id long", commits)
        postings = self._table("postings", post.POSTINGS, commits)
        log = self._log_of(self._commits())  # labels as they are now, as for any reader
        if before is not None:
            docs, postings, log = (t.filter(F.col("doc_id") < before) for t in (docs, postings, log))
        if after is not None:
            docs, postings, log = (t.filter(F.col("doc_id") > after) for t in (docs, postings, log))
        return plan(query, docs, postings, label_ops.current(log))

    def _newest(self, query: Query, commits: list[dict], n: int, before: int | None = None) -> list[int]:
        """The n largest matching ids below ``before``. Goes down in steps of ever more ids and
        stops when there are enough, so that neither old batches nor the row groups of old
        ids are read for a frequent word."""
        spans = [(c["min_doc_id"], c["max_doc_id"]) for c in commits if c["max_doc_id"] is not None]
        if not spans:
            return []
        least, top = min(a for a, _ in spans), max(b for _, b in spans) + 1
        top = top if before is None else min(top, before)
        found: list[int] = []
        step = max(FIRST_STEP, 32 * n)
        while top > least and len(found) < n:
            # ids that no batch has cost no step
            top = min(top, max((b + 1 for a, b in spans if a < top), default=least))
            after = top - 1 - step
            rows = self._find(query, commits, top, after if after >= least else None).orderBy(F.desc("doc_id")).limit(n - len(found)).collect()
            found += [r.doc_id for r in rows]
            top, step = after + 1, step * 16
        return found

    def find(self, query: Query | str, default_field: str = "body") -> DataFrame:
        """DataFrame[doc_id] of all matches, in no order."""
        return self._find(self._query(query, default_field), self._commits())

    def matches(self, query: Query | str, default_field: str = "body") -> DataFrame:
        """(doc_id, field, word, positions) of the query's words in the documents that match; words that only stand under a negation aren't listed."""
        query = self._query(query, default_field)

        def said(node: Query) -> set[tuple[str, str]]:
            if isinstance(node, Term):
                return {(node.field, node.word)}
            return set() if isinstance(node, Not) else set().union(*map(said, node.children))

        commits = self._commits()
        words = said(query)
        postings = self._table("postings", post.POSTINGS, commits)
        wanted = F.lit(False)
        for field, word in sorted(words):
            wanted = wanted | ((F.col("field") == field) & (F.col("word") == word))
        return postings.filter(wanted).join(self._find(query, commits), "doc_id", "left_semi").select("doc_id", "field", "word", "positions")

    def search(self, query: Query | str, limit: int | None = None, default_field: str = "body") -> list[int]:
        """Matching ids, newest first."""
        if limit is not None:
            return self._newest(self._query(query, default_field), self._commits(), limit)
        return [r.doc_id for r in self.find(query, default_field).orderBy(F.desc("doc_id")).collect()]

    def cursor(self, query: Query | str, default_field: str = "body") -> Cursor:
        return Cursor(self, self._query(query, default_field))

    def iter_results(self, query: Query | str, chunk: int = 10, default_field: str = "body") -> Iterator[int]:
        cursor = self.cursor(query, default_field)
        while ids := cursor.next(chunk):
            yield from ids

    def count(self, query: Query | str, default_field: str = "body") -> int:
        """Number of matches; that of a term comes from the word statistics, that of a label from the
        label statistics if no label has come or gone since they were merged."""
        query = self._query(query, default_field)
        if isinstance(query, Term):
            stats = self._table("stats", STATS, self._commits())
            return stats.filter((F.col("field") == query.field) & (F.col("word") == query.word)).agg(F.coalesce(F.sum("df"), F.lit(0))).collect()[0][0]
        if isinstance(query, Label):
            counts = self.label_stats().filter(F.col("label") == query.name)
            return counts.agg(F.coalesce(F.sum("df"), F.lit(0))).collect()[0][0]
        return self.find(query).count()

    def size(self) -> int:
        """Number of documents."""
        return sum(c["docs"] for c in self._commits())

    def with_columns(self, found: DataFrame) -> DataFrame:
        """The stored columns of found documents."""
        return self.docs().join(found, "doc_id", "left_semi")

    def optimize(self, files: int | None = None) -> bool:
        """Rewrites all batches of documents as one and all batches of labels as what documents
        carry now, lists them in a snapshot, and removes the old files; whether there was
        anything to do. For use when nothing reads the index; writers may go on."""
        commits = self._commits()
        batch = uuid.uuid4().hex
        old = [c for c in commits if "postings" in c["tables"]]
        if len(old) > 1:
            at = {t: f"{self.path}/{t}/batch={batch}" for t in ("docs", "postings", "stats")}
            tasks = files or self._tasks(*[f"postings/batch={c['batch']}" for c in old if "postings" in c["tables"]])
            post.clustered(post.blocks(self._table("postings", post.POSTINGS, old)), tasks).write.parquet(at["postings"])
            self._table("docs", None, old).write.parquet(at["docs"])
            post.term_stats(self.spark.read.schema(post.POSTINGS).parquet(at["postings"])).write.parquet(at["stats"])
            ids = [(c["min_doc_id"], c["max_doc_id"]) for c in old if c["max_doc_id"] is not None]
            self._replace(batch, list(at), old, {"docs": sum(c["docs"] for c in old), "min_doc_id": min((a for a, _ in ids), default=None), "max_doc_id": max((b for _, b in ids), default=None), "ordered": True})
        logs = [c for c in commits if "labels" in c["tables"]]
        if len(logs) > 1 or any("label_stats" not in c["tables"] for c in logs):
            batch = uuid.uuid4().hex
            now = label_ops.current(self._log_of(logs)).select(F.lit(label_ops.ADD).alias("op"), "label", "doc_id")
            now.repartitionByRange("label", "doc_id").sortWithinPartitions("label", "doc_id").write.parquet(f"{self.path}/labels/batch={batch}")
            label_ops.label_counts(self.spark.read.schema(label_ops.STORED).parquet(f"{self.path}/labels/batch={batch}")).write.parquet(f"{self.path}/label_stats/batch={batch}")
            self._replace(batch, ["labels", "label_stats"], logs, {"docs": 0, "min_doc_id": None, "max_doc_id": None, "seq": max(c["seq"] for c in logs)})
        if len(old) < 2 and all("label_stats" in c["tables"] for c in logs) and len(logs) < 2:
            return False
        last = self._snapshot()
        for n in self._numbers("commits"):
            if n < last:
                self.folder.delete(f"commits/{n}")
        for n in self._numbers("snapshots"):
            if n < last:
                self.folder.delete(f"snapshots/{n}")
        return True

    def _replace(self, batch: str, tables: list[str], old: list[dict], about: dict) -> None:
        sources = [s for c in old for s in [*c.get("sources", []), c.get("source")] if s]
        self._commit({"batch": batch, "tables": tables, "source": None, "sources": sources, "replaces": [c["batch"] for c in old], **about})
        for c in old:
            for t in tables:
                self.folder.delete(f"{t}/batch={c['batch']}")
