"""``python -m strata.cli``: validate, inspect, convert, render, run, step and schema for documents and edit programs in files.

Exit codes: 0 done, 1 refused, 2 usage, 3 a file can't be read or written. ``-`` is standard input or output; a file is written beside
its place and moved there when it is whole, and never over its input.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from strata.sources import schema as shapes


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("strata").getOrCreate()


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strata")
    commands = parser.add_subparsers(dest="command", required=True)
    texts = {
        "validate": "list what is refused",
        "inspect": "count the parts",
        "convert": "canonical JSON",
        "render": "a DOT graph",
        "run": "the document that an edit program builds",
        "step": "a line for each op with the document after it",
    }
    for name, text in texts.items():
        one = commands.add_parser(name, help=text)
        one.add_argument("path")
        one.add_argument("-o", "--output", default="-")
        if name in ("convert", "run"):
            one.add_argument("--to", choices=("json", "json-compact"), default="json")
    commands.add_parser("schema", help="print the JSON Schema").add_argument("-o", "--output", default="-")
    return parser


def _write(text: str, output: str, source: str | None = None) -> None:
    if output == "-":
        sys.stdout.write(text)
        return
    if source not in (None, "-") and os.path.exists(source) and os.path.realpath(source) == os.path.realpath(output):
        raise OSError("the output is the input")
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(output)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(beside, output)
    except BaseException:
        os.unlink(beside)
        raise


def _documents(spark, path: str):
    from strata.sources import wire

    if path == "-":
        return spark.createDataFrame([("-", sys.stdin.read())], "doc string, raw string")
    if not any(c in path for c in "*?[{") and not os.path.exists(path):
        raise OSError(f"no such file: {path}")
    return wire.read_documents(spark, path)


def _refused(rows) -> bool:
    bad = False
    for r in rows.orderBy("doc", "path", "message").toLocalIterator():
        bad = True
        print(f"{r.doc}: {r.path}: {r.message}", file=sys.stderr)
    return bad


def _programs(spark, args) -> int:
    from strata.sources import program, wire

    documents = _documents(spark, args.path)
    if _refused(program.violations(documents)):
        return 1
    ops = program.flattened(documents)
    stops = {r.doc: r for r in program.first_refusal(ops).collect()}  # one row a program
    for r in stops.values():
        print(f"{r.doc}: op {r.seq}: {r.reason}", file=sys.stderr)
    if args.command == "run":
        if stops:
            return 1
        built = program.replay(ops)
        built = built if args.to == "json-compact" else wire.pretty(built)
        end = "\n" if args.to == "json-compact" else ""
        _write("".join(r.text + end for r in built.orderBy("doc").toLocalIterator()), args.output, args.path)
        return 0
    lines = program.steps(ops).orderBy("doc", "seq").toLocalIterator()
    good = (r for r in lines if r.doc not in stops or r.seq < stops[r.doc].seq)
    _write("".join(json.dumps({"index": r.seq, "opcode": r.op, "document": json.loads(r.text)}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for r in good), args.output, args.path)
    return int(bool(stops))


def _on_documents(spark, args) -> int:
    from strata.sources import render, wire

    documents = _documents(spark, args.path)
    refused = wire.violations(documents)
    bad = _refused(refused)
    out = ""
    if args.command == "inspect":
        out = "".join(r.line + "\n" for r in wire.inspect(wire.parse(documents, refused)).orderBy("doc", "ord").toLocalIterator())
    if args.command == "convert":
        compact = wire.dumps(documents.join(refused.select("doc").distinct(), "doc", "left_anti"))
        rows = compact if args.to == "json-compact" else wire.pretty(compact)
        out = "".join(r.text + ("\n" if args.to == "json-compact" else "") for r in rows.orderBy("doc").toLocalIterator())
    if args.command == "render":
        parsed = wire.parse(documents, refused)
        for r in parsed.select("doc").orderBy("doc").collect():  # files named on the command line
            out += render.whole(render.dot_lines(wire.corpus(parsed.where(parsed["doc"] == r.doc)))).first().text + "\n"
    if out:
        _write(out, args.output, args.path)
    return int(bad)


def main(arguments: list[str] | None = None) -> int:
    args = build_parser().parse_args(arguments)
    try:
        if args.command == "schema":
            _write(json.dumps(shapes.json_schema(), indent=2, sort_keys=True) + "\n", args.output)
            return 0
        return (_programs if args.command in ("run", "step") else _on_documents)(_session(), args)
    except OSError as error:
        print(f"strata: {error}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
