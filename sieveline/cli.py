"""Command line: ``python -m sieveline.cli COMMAND INDEX ...``

    index-files INDEX FILE...    one document a file
    index-mbox INDEX FILE...     one document a mail, labelled inbox
    search INDEX QUERY           count, newest ids and excerpts
    count INDEX                  counts and times the queries of standard input
    interactive INDEX            searches the queries of standard input
    benchmark INDEX FILE         time of each query, and queries a second; ten results each
    make-queries INDEX           random queries from the stored bodies
    dump INDEX                   all postings
    info INDEX                   totals
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .functions.snippets import excerpt, snippet_spans
from .operators.index import Index
from .plans.ast import QueryError
from .plans.parser import ParseError, parse
from .sources import files

SHOWN, SNIPPETS, LONGEST = 3, 3, 64 << 10


def show(index: Index, text: str, out=sys.stdout) -> None:
    query = parse(text, "body")
    print(f"performing search: {query}", file=out)
    began = time.time()
    n = index.count(query)
    print(f"found {n} results in {(time.time() - began) * 1000:.1f}ms", file=out)
    ids = index.search(query, SHOWN)
    bodies = {}
    docs = index.docs()
    if ids and "body" in docs.columns:
        bodies = {r.doc_id: r.body for r in docs.filter(docs.doc_id.isin(ids)).select("doc_id", "body").collect()}
    for doc_id in ids:
        print(f"found doc {doc_id}", file=out)
        body = (bodies.get(doc_id) or "").encode()[:LONGEST].decode(errors="ignore")
        for span in snippet_spans(query, "body", body, SNIPPETS):
            print(f"| {excerpt(body, span)}", file=out)


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout, lines=sys.stdin) -> int:
    if len(args) < 2:
        print(__doc__, file=out)
        return 2
    command, path, *rest = args
    spark = spark or SparkSession.builder.appName("sieveline").getOrCreate()
    if command in ("index-files", "index-mbox"):
        index = Index.open(spark, path)
        began = time.time()
        n = (files.index_mbox if command == "index-mbox" else files.index_text_files)(index, rest)
        print(f"added {n} documents in {time.time() - began:.1f}s", file=out)
        return 0
    index = Index.load(spark, path)
    if command == "search":
        show(index, " ".join(rest), out)
    elif command == "info":
        for name, value in index.stats().first().asDict().items():
            print(f"{name}: {value}", file=out)
    elif command == "dump":
        for r in index.dump().toLocalIterator():
            print(f"{r.field}:{r.word} @{r.doc_id} {r.positions}", file=out)
    elif command == "make-queries":
        for r in files.random_queries(index.docs(), share=0.01).toLocalIterator():
            print(r.query, file=out)
    elif command == "benchmark":
        began, n = time.time(), 0
        with open(rest[0], encoding="utf-8") as f:
            for line in f:
                since = time.time()
                found = len(index.cursor(line).next(10))
                n += 1
                print(f"{(time.time() - since) * 1000:.1f}ms {found} {line.strip()}", file=out)
        print(f"{n} queries, {n / max(1e-9, time.time() - began):.2f} a second", file=out)
    elif command in ("count", "interactive"):
        for line in lines:
            try:
                if command == "interactive":
                    show(index, line, out)
                else:
                    began = time.time()
                    n = index.count(line)
                    print(f"found {n} results in {(time.time() - began) * 1000:.1f}ms", file=out)
            except (ParseError, QueryError) as e:
                print(e, file=out)
    else:
        print(__doc__, file=out)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
