"""python -m lattice STORE train|ask|consolidate ...: the engine from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main() -> None:
    parser = argparse.ArgumentParser(prog="lattice")
    parser.add_argument("store")
    parser.add_argument("--workspace", default="default")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("train").add_argument("path", help="a file or folder of documents")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("-k", type=int, default=5)
    ask.add_argument("--mode", default="hybrid", choices=["episodic", "causal", "hybrid"])
    commands.add_parser("consolidate").add_argument("--threshold", type=float, default=0.85)
    args = parser.parse_args()

    from lattice.engine import Engine
    from lattice.session import build_session
    from lattice.sources.loaders import load

    spark = build_session()
    engine = Engine(spark, args.store)
    engine.create_workspace(args.workspace)
    if args.command == "train":
        docs = load(spark, args.path).where("content is not null").select(F.xxhash64("path").alias("doc_id"), F.col("content").alias("text"))
        engine.train(args.workspace, docs).show()
    elif args.command == "ask":
        engine.retrieve(args.workspace, {"q": args.question}, args.mode, args.k).orderBy("rank").select("rank", "layer", "rl_score", "content").show(args.k, 100)
    else:
        engine.consolidate(args.workspace, args.threshold).show()


if __name__ == "__main__":
    main()
