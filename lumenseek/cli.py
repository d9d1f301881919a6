"""Command line: ``python -m lumenseek.cli [options] <command>``; words alone are searched for."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenseek import __version__
from lumenseek.functions import formatting
from lumenseek.operators import embedders, indexer, search, stats, store
from lumenseek.sources import gitfiles, tables

COMMANDS = ("search", "index", "stats", "clear", "push", "pull", "config-remote", "gc")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenseek", description="Search tracked files by meaning.")
    out.add_argument("--version", action="version", version=os.environ.get("LUMENSEEK_VERSION", __version__))
    out.add_argument("--repo", default=".", help="a git working tree, or a directory with --directory")
    out.add_argument("--directory", action="store_true", help="take all files below --repo, without git")
    out.add_argument("--store", help="where the vectors lie (default: below the git directory)")
    out.add_argument("--model", default="hash-256")
    out.add_argument("--backend", default="auto", choices=["auto", "cpu", "onnx", "http", "mlx"])
    out.add_argument("--model-dir", help="directory with model.onnx and tokenizer.json")
    out.add_argument("--url", help="service for the http backend")
    out.add_argument("--workers", type=int, default=1, help="threads of a model session")
    commands = out.add_subparsers(dest="command")
    for name in COMMANDS:
        sub = commands.add_parser(name)
        if name in ("search", "index"):
            sub.add_argument("--batch-size", type=int)
            sub.add_argument("-q", "--quiet", action="store_true")
            sub.add_argument("-v", "--verbose", action="store_true")
        if name == "search":
            sub.add_argument("query", nargs="*")
            sub.add_argument("-k", "--top-k", type=int, default=10)
            sub.add_argument("--path", help="only paths with this prefix")
            sub.add_argument("--show", action="store_true", help="print the matching lines")
            sub.add_argument("--no-auto-index", action="store_true")
            sub.add_argument("--json", action="store_true")
        if name in ("push", "pull", "config-remote"):
            sub.add_argument("--remote", default="origin", help="a configured name, or a location")
        if name == "push":
            sub.add_argument("--force", action="store_true")
        if name == "config-remote":
            sub.add_argument("location", help="where the remote store lies")
        if name == "gc":
            sub.add_argument("--vacuum", action="store_true")
    return out


def normalized(argv: Sequence[str]) -> list[str]:
    """Insert ``search`` if no command is given before the first word."""
    valued = {"--repo", "--store", "--model", "--backend", "--model-dir", "--url", "--workers"}
    i = 0
    while i < len(argv):
        if argv[i] in valued:
            i += 2
        elif argv[i] in ("--directory", "-h", "--help", "--version") or argv[i].split("=")[0] in valued:
            i += 1
        else:
            break
    rest = list(argv[i:])
    return list(argv) if not rest or rest[0] in COMMANDS else [*argv[:i], "search", *rest]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(normalized(sys.argv[1:] if argv is None else argv))
    if not args.command:
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.appName("lumenseek").getOrCreate()
    root = args.repo if args.directory else gitfiles.find_root(args.repo)
    location = args.store or (f"{root}/.lumenseek" if args.directory else f"{root}/.git/lumenseek")
    spec = embedders.parse_model(args.model, "mlx" if args.backend == "mlx" else "cpu")
    kept = store.Store(spark, location, spec.short, spec.dim)

    def files(content: bool):
        if args.directory:
            found = tables.from_directory(spark, root).where(~F.col("path").startswith(".lumenseek/"))
            return found if content else found.drop("content")
        return gitfiles.read(spark, root, content=content)

    def refreshed(model, quiet, verbose=args.command in ("search", "index") and args.verbose):
        if args.directory:
            return indexer.index(spark, files(True), kept, model, quiet=quiet, verbose=verbose)
        return indexer.index(spark, files(False), kept, model, read=lambda rows: gitfiles.contents(rows, root), quiet=quiet, verbose=verbose)

    def embedder():
        found = embedders.build(args.model, args.backend, directory=args.model_dir, url=args.url, threads=args.workers)
        found.batch_size = embedders.effective_batch_size(args.batch_size, found.batch_size)
        return found

    if args.command == "index":
        done = refreshed(embedder(), args.quiet)
        print(done)
    elif args.command == "search":
        query = search.query_text(args.query)
        model = embedder()
        if not args.no_auto_index:
            done = refreshed(model, args.quiet or args.json)
            if args.verbose:
                print(f"[index] {done}", file=sys.stderr)
        hits = search.search_store(spark, kept, files(False), model.embed([query])[0], args.top_k, args.path)
        text = search.render(hits, as_json=args.json, show=files(True) if args.show else None)
        if text:
            print(text)
    elif args.command == "stats":
        print(formatting.store_report(stats.report(kept, files(False)), args.backend))
    elif args.command == "clear":
        print(f"deleted {spec.short}" if kept.clear() else f"nothing stored for {spec.short}")
    elif args.command == "config-remote":
        print(f"added remote {args.remote}" if store.configure_remote(spark, location, args.remote, args.location) else "already configured")
    elif args.command in ("push", "pull"):
        remote = args.remote if "/" in args.remote else store.remote_url(spark, location, args.remote)
        done = store.push(spark, location, remote, force=args.force) if args.command == "push" else store.pull(spark, location, remote)
        print(f"{args.command}: {', '.join(done) or 'nothing'}")
    elif args.command == "gc":
        found = kept.gc(vacuum=args.vacuum)
        print(f"collapsed history of {spec.short}: {found[0][:12]} -> {found[1][:12]}" if found else f"nothing stored for {spec.short}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
