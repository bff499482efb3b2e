"""Command line: ``python -m scribeframe run -`` answers one JSON request of standard input; the other commands build it.

One JSON document is printed. Exit code 0, 2 for wrong input or a missing file, else 1; ``check`` of an invalid
transcript gives 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from scribeframe.plans.dispatch import invalid


def word_ranges(text: str) -> list[list[int]]:
    """``12-40,55`` as [[12, 40], [55, 55]]."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        if not first.isdecimal() or not (last or first).isdecimal():
            raise invalid(f"{part!r} is not N or N-M", "bad_word_ranges")
        out.append([int(first), int(last or first)])
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scribeframe")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name)
    add("run").add_argument("request", choices=["-"])
    p = add("find")
    p.add_argument("phrase")
    p.add_argument("transcripts", nargs="+")
    p.add_argument("--fuzzy", type=float)
    p.add_argument("--context", type=int, default=1)
    p = add("select")
    p.add_argument("transcript")
    p.add_argument("--mode", default="remove")
    p.add_argument("--words")
    p.add_argument("--segments", nargs="+")
    p.add_argument("--overlap", default="refuse")
    p = add("segments")
    p.add_argument("transcript")
    p.add_argument("--merge-gap", type=float, default=0.0)
    p = add("export")
    p.add_argument("transcript")
    p.add_argument("output")
    p.add_argument("--format", default="json")
    p = add("check")
    p.add_argument("transcript")
    p = add("engines")
    p.add_argument("--capability")
    return top


def request(args: argparse.Namespace) -> dict:
    params = {k: v for k, v in vars(args).items() if k != "command" and v is not None}
    if "words" in params:
        params["words"] = word_ranges(params["words"])
    return {"tool": f"transcription/{args.command}", "params": params}


def main(argv: list[str] | None = None) -> int:
    from scribeframe.plans import dispatch

    args = parser().parse_args(argv)
    try:
        raw = sys.stdin.read() if args.command == "run" else json.dumps(request(args))
    except dispatch.Refusal as e:
        found, code = e.document(), e.exit_code
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("scribeframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        found, code = dispatch.respond(spark, raw)
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 1 if code == 0 and args.command == "check" and not found["result"]["ok"] else code


if __name__ == "__main__":
    sys.exit(main())
