"""Command line: retrieval from a store, checks, ingests, and any query by name, as JSON lines.

    python -m lodestone.cli ingest /data/dir /store/dir [--full] [--strict]      exits with 1 if strict and an integrity rule finds an error
    python -m lodestone.cli status /store/dir
    python -m lodestone.cli query /store/dir "a question" [--collection technical] [--top-k 5] [--no-citations]
    python -m lodestone.cli expand /store/dir ep::repo::operation
    python -m lodestone.cli query-code /data/dir [--repo src1]
    python -m lodestone.cli deep-query /data/dir
    python -m lodestone.cli repos /data/dir                 exits with 1 if a repository's validation fails
    python -m lodestone.cli validate-citations /data/dir
    python -m lodestone.cli validate /data/dir              exits with 1 if an integrity rule finds an error
    python -m lodestone.cli eval /data/dir                  exits with 1 if a retrieval, diversity, routing or orchestrator case fails
    python -m lodestone.cli list
    python -m lodestone.cli run hybrid_query /data/dir
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Retrieval
from lodestone.operators import answer, embed, links
from lodestone.plans import catalog, indexed, ingest, ranking
from lodestone.session import build
from lodestone.sources.store import Store
from lodestone.sources.tables import entity_chunks

#: Result rows printed, a report's length; a line on stderr says if there are more.
SHOWN = 1000
EVALS = ("retrieval_eval", "diversity_eval", "routing_eval", "orchestrator_eval")


def _print(df: DataFrame) -> None:
    lines = df.limit(SHOWN + 1).toJSON().collect()
    for line in lines[:SHOWN]:
        print(line)
    if len(lines) > SHOWN:
        print(f"more than {SHOWN} rows: the first are shown", file=sys.stderr)


def _query(spark: SparkSession, args: argparse.Namespace) -> int:
    store = Store(spark, args.store)
    asked = spark.createDataFrame([(0, args.question)], "item_id long, text string").withColumn("vector", embed.letters(F.col("text")))
    config = Retrieval(**({"top_k": args.top_k} if args.top_k else {}))
    hits = indexed.hits(store, asked, config, collection=args.collection)
    shown = answer.with_citations(hits, store.docstore()) if args.citations else links.public_id(hits)
    _print(shown.orderBy("rank").select("rank", "id", "title", "doc_type", "collection", "content", "score", *(["citations"] if args.citations else [])))
    return 0


def _expand(spark: SparkSession, args: argparse.Namespace) -> int:
    chunks = Store(spark, args.store).docstore()
    found = links.expand(spark.createDataFrame([(args.id,)], "id string"), links.id_index(chunks), chunks)
    _print(found.join(chunks, ["collection", "node_id"]).select("title", "doc_type", "collection", "content"))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("data")
    for name in ("validate", "eval", "deep-query", "query-code", "repos", "validate-citations"):
        own = commands.add_parser(name)
        own.add_argument("data")
        if name == "query-code":
            own.add_argument("--repo", help="one repository alone")
    commands.add_parser("status").add_argument("store")
    ask = commands.add_parser("query")
    ask.add_argument("store")
    ask.add_argument("question")
    ask.add_argument("--collection")
    ask.add_argument("--top-k", type=int, default=0)
    ask.add_argument("--no-citations", dest="citations", action="store_false")
    expand = commands.add_parser("expand")
    expand.add_argument("store")
    expand.add_argument("id")
    sync = commands.add_parser("ingest")
    sync.add_argument("data")
    sync.add_argument("store")
    sync.add_argument("--full", action="store_true", help="forget what is stored")
    sync.add_argument("--strict", action="store_true", help="fail if the stored chunks break an integrity rule")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(catalog.QUERIES))
        return 0
    spark = build()
    query = lambda name: catalog.QUERIES[name](spark, args.data)
    if args.command == "ingest":
        report = ingest.run(spark, args.store, entity_chunks(spark, args.data), args.full, args.strict, embed.letters(F.col("content")), indexed=True)
        print(json.dumps(asdict(report)))
        return int(not report.ok)
    if args.command == "status":
        print("\n".join(Store(spark, args.store).status()))
        return 0
    if args.command in ("query", "expand"):
        return (_query if args.command == "query" else _expand)(spark, args)
    if args.command in ("run", "deep-query", "validate-citations"):
        _print(query({"deep-query": "deep_query_cited", "validate-citations": "citation_check"}.get(args.command) or args.query))
        return 0
    if args.command == "query-code":
        _print(ranking.query_code(spark, args.data, repo=args.repo))
        return 0
    if args.command == "repos":
        steps = query("repo_validate")
        _print(steps.orderBy("repo", "position"))
        return int(steps.where("NOT ok").count() > 0)
    if args.command == "validate":
        counts = {r["severity"]: r["n"] for r in query("integrity_summary").collect()}
        print(counts)
        return int(counts.get("error", 0) > 0)
    failed = {name: query(name).where("NOT passed").count() for name in EVALS}
    print(failed)
    return int(any(failed.values()))


if __name__ == "__main__":
    sys.exit(main())
