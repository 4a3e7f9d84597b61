"""Command line: index, update, watch, search, context, graph, list, status, reset, and a shell of these."""

from __future__ import annotations

import argparse
import os

from codeloom.commands import parse_command
from codeloom.config import load_settings
from codeloom.engine import Engine
from codeloom.session import build_session
from codeloom.streaming.service import WatchService


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    top.add_argument("--store", default=os.environ.get("CODELOOM_STORE", ".codeloom"), help="folder of the index")
    top.add_argument("--config", help="settings file")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("index", "update", "watch"):
        commands.add_parser(name).add_argument("path")
    commands.add_parser("shell")
    ask = commands.add_parser("search")
    ask.add_argument("query")
    ask.add_argument("--mode", default="hybrid", choices=["hybrid", "vector", "grep", "fuzzy", "summary"])
    ask.add_argument("--limit", type=int, default=0)
    ask.add_argument("--path", dest="root")
    commands.add_parser("context").add_argument("symbol")
    around = commands.add_parser("graph")
    around.add_argument("symbol")
    around.add_argument("--type", default="callees", choices=["callers", "callees", "dependents", "dependencies"])
    around.add_argument("--depth", type=int, default=1)
    for name in ("list", "status", "reset"):
        commands.add_parser(name)
    args = top.parse_args(argv)
    engine = Engine(build_session(), os.path.abspath(args.store), load_settings(args.config))
    if args.command != "shell":
        run(engine, args)
        return 0
    while True:
        try:
            command = parse_command(input("codeloom> "))
        except EOFError:
            return 0
        except ValueError as error:
            print(error)
            continue
        if command.name in ("exit", "quit"):
            return 0
        if command.name:
            words = [command.name, *command.args, *(x for k, v in command.options.items() for x in (f"--{k}", v))]
            try:
                inner = top.parse_args(words)
                if inner.command != "shell":
                    run(engine, inner)
            except SystemExit:  # what argparse says of a wrong command is enough
                continue


def run(engine: Engine, args: argparse.Namespace) -> None:
    if args.command in ("index", "update"):
        getattr(engine, args.command)(os.path.abspath(args.path)).show(truncate=False)
    elif args.command == "watch":
        root = os.path.abspath(args.path)
        service = WatchService(engine.spark, root, os.path.join(engine.tables.root, "watch"), lambda: engine.update(root), engine.settings.debounce_ms / 1000)
        query = service.start()
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            service.stop()
            print(service.stats())
    elif args.command == "search":
        engine.search(args.query, args.mode, args.limit, os.path.abspath(args.root) if args.root else None).select("file_path", "start_line", "end_line", "score").show(100, truncate=False)
    elif args.command == "context":
        print(engine.get_context(args.symbol).toJSON().first())
    elif args.command == "graph":
        nodes, edges = engine.get_graph(args.symbol, args.type, args.depth)
        nodes.select("symbol_id", "file_path", "distance").show(100, truncate=False)
        edges.select("source_id", "target_id", "edge_type").show(100, truncate=False)
    elif args.command == "list":
        engine.repositories().show(100, truncate=False)
    elif args.command == "status":
        engine.status().show(truncate=False)
    else:
        engine.reset()


if __name__ == "__main__":
    raise SystemExit(main())
