"""``python -m quarry.cli build | check QUESTION | ask QUESTION | chat`` with a settings file."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from quarry import models as built_in
from quarry.plans import evidence
from quarry.session import local_session
from quarry.sources import config, files


def rendered(question: str, got: evidence.Checked) -> str:
    if not got.evidence:
        return f"NOT FOUND: {question}"
    lines = [f"FOUND in {len(got.evidence)} file(s): {question}"]
    lines += [f"  {e['score']:.4f}  [{e['knowledge_base']}] {e['file']} ({e['chunk_count']} chunk(s))" for e in got.evidence]
    return "\n".join([*lines, *(["", got.answer] if got.answer else [])])


def questions(lines: Iterable[str]) -> Iterable[str]:
    """Non-blank lines until ``exit`` or ``quit``."""
    for line in lines:
        q = line.strip()
        if q.lower() in ("exit", "quit"):
            return
        if q:
            yield q


def parser_of(name: str | None) -> files.Parser | None:
    return {"tables": files.pdfplumber_parser, "stream": files.stream_parser, None: None}[name]


def main(argv: list[str] | None = None, models: evidence.Models | None = None) -> int:
    """Models come from the settings unless given.  ``chat`` asks each line of the input."""
    a = argparse.ArgumentParser(prog="quarry")
    a.add_argument("command", choices=["build", "check", "ask", "chat"])
    a.add_argument("question", nargs="?")
    a.add_argument("--config", default="config.yaml")
    a.add_argument("--pdf", choices=["tables", "stream"])
    args = a.parse_args(argv)
    if args.command in ("check", "ask") and not (args.question or "").strip():
        a.error(f"{args.command} needs a question")
    try:
        settings = config.load(args.config)
        models = models or built_in.from_settings(settings)
        spark = local_session("quarry-cli")
        if args.command == "build":
            got = evidence.build(spark, settings, models, parser_of(args.pdf))
            print(f"{got.files_ok} file(s) indexed, {got.files_skipped} skipped, {got.chunks} chunk(s)" if got else "nothing to index")
            return 0
        asked = questions(sys.stdin) if args.command == "chat" else [args.question]
        for q in asked:
            if args.command in ("ask", "chat"):
                answer, sources = evidence.ask(spark, settings, q, models)
                print("\n".join([answer, *sources]))
            else:
                print(rendered(q, evidence.check(spark, settings, q, models)))
        return 0
    except (config.SettingsError, config.IndexMissing, config.ModelMissing) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
