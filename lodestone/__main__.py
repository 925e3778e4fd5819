"""Command line: python -m lodestone --index DIR [--root DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--index", default=".index")
    p.add_argument("--root")
    p.add_argument("--config", default=".index-config.json")
    p.add_argument("--lists", default=os.path.expanduser("~/.index-lists.json"))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("queries", nargs="+")
    s.add_argument("--top-k", type=int)
    s.add_argument("--threshold", type=float)
    s.add_argument("--path")
    s.add_argument("--no-hybrid", action="store_true")
    for name in ("sync", "reindex", "gc", "status", "report", "serve", "cancel", "session"):
        sub.add_parser(name)
    c = sub.add_parser("config")
    c.add_argument("action", choices=("show", "set", "provider", "reset"))
    c.add_argument("values", nargs="*")
    for name in ("deny", "allow"):
        a = sub.add_parser(name)
        a.add_argument("action", choices=("add", "remove", "list"))
        a.add_argument("path", nargs="?", default=".")
    args = p.parse_args(argv)

    from lodestone.config import AccessList, ConfigFile

    settings, lists = ConfigFile(args.config), AccessList(args.lists)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False, default=str))
    if args.command == "config":
        act = {"show": settings.show, "set": settings.set, "provider": settings.use_provider, "reset": settings.reset}[args.action]
        show(act(*args.values))
        return 0
    if args.command in ("deny", "allow"):
        act = {"add": lists.add, "remove": lists.discard}.get(args.action)
        show(act(args.command, args.path) if act else lists.entries(args.command))
        return 0

    from pyspark.sql import SparkSession

    from lodestone.plans.engine import Engine
    from lodestone.plans.tools import ToolServer, session_text, status_line

    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.index, args.root, settings.user())
    if args.command == "search":
        print(engine.search_json(args.queries, top_k=args.top_k, threshold=args.threshold, path=args.path, mode="semantic" if args.no_hybrid else "hybrid"))
    elif args.command in ("sync", "reindex"):
        if not engine.allowed(lists.entries("allow"), lists.entries("deny"), os.path.expanduser("~")):
            print("this directory is on the deny list")
            return 1
        show(getattr(engine, args.command)())
    elif args.command == "gc":
        show(engine.gc())
    elif args.command == "cancel":
        show(engine.cancel())
    elif args.command == "session":
        print(session_text(engine.index_status()), end="")
    elif args.command == "status":
        print(status_line(engine.index_status()))
    elif args.command == "report":
        show(engine.report())
    else:
        ToolServer(engine).serve()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
