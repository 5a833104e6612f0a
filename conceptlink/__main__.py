"""Command line: init, map, search, serve."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

from . import service
from .operators.datasets import expression_dataset, save_datasets
from .operators.index import build_index
from .plans.mapper import EMBEDDERS, ConceptMapper
from .schemas import STANDARD_VOCABULARIES
from .sources.config import MappingTask
from .sources.vocabulary import load_vocabulary, save_vocabulary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="conceptlink")
    commands = top.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="vocabulary files to tables, datasets and an index")
    init.add_argument("vocab_dir")
    init.add_argument("--root", required=True)
    init.add_argument("--embedding-model", default="offline-hash", choices=sorted(EMBEDDERS.entries))
    init.add_argument("--standard-vocabs", nargs="+", default=list(STANDARD_VOCABULARIES))
    init.add_argument("--mode", default="repair", choices=("skip", "repair", "overwrite"))
    init.add_argument("--rate-limit", type=int)
    run = commands.add_parser("map", help="map the source concepts of a CSV file")
    run.add_argument("--task-config")
    run.add_argument("--root", required=True)
    for name in ("input-file", "output-dir", "translator-id", "retriever-id", "selector-id", "reranker-id"):
        run.add_argument(f"--{name}")
    for name in ("batch-size", "rate-limit", "limit-to"):
        run.add_argument(f"--{name}", type=int)
    find = commands.add_parser("search", help="nearest expressions of each query")
    find.add_argument("queries", nargs="+")
    find.add_argument("--root", required=True)
    find.add_argument("--retriever-id")
    find.add_argument("--top-k", type=int, default=10)
    serve = commands.add_parser("serve", help="answer /map and /search over HTTP")
    serve.add_argument("--root", required=True)
    serve.add_argument("--host")
    serve.add_argument("--port", type=int)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=os.environ.get("CONCEPTLINK_LOG", "INFO"), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    if args.command == "init" and not set(args.standard_vocabs) <= set(STANDARD_VOCABULARIES):
        raise SystemExit(f"standard vocabularies are {', '.join(STANDARD_VOCABULARIES)}")
    spark = SparkSession.builder.appName("conceptlink").getOrCreate()
    if args.command == "init":
        tables = load_vocabulary(spark, args.vocab_dir)
        save_vocabulary(tables, f"{args.root}/vocabulary", "skip" if args.mode == "skip" else "overwrite")
        data = expression_dataset(tables["concept"], tables["concept_synonym"], tables["concept_relationship"], args.standard_vocabs)
        save_datasets(data, f"{args.root}/datasets", "skip" if args.mode == "skip" else "overwrite")
        build_index(spark.read.parquet(f"{args.root}/datasets"), args.root, EMBEDDERS.load(args.embedding_model), args.mode, rate_limit=args.rate_limit)
    elif args.command == "map":
        given = {k: v for k, v in vars(args).items() if k in MappingTask.__dataclass_fields__ and v is not None}
        task = MappingTask.load(args.task_config) if args.task_config else MappingTask(**given)
        for k, v in given.items():
            setattr(task, k, v)
        ConceptMapper.from_task(spark, task, args.root).map(save_to_disk=True, output_dir=task.output_dir or args.root)
    elif args.command == "search":
        request = {"queries": args.queries, "retriever_id": args.retriever_id, "top_k": args.top_k}
        print(json.dumps(service.search(spark, args.root, request), indent=2))
    else:
        service.serve(spark, args.root, args.host, args.port).serve_forever()


if __name__ == "__main__":
    main()
