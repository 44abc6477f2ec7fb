"""Command line: evaluate an expression over JSON files, or validate them.

    python -m lumenpath.cli path EXPRESSION FILE [--json] [--spec]
    python -m lumenpath.cli validate --definitions FOLDER FILE... [--terminology FOLDER]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lumenpath.interp.evaluator import evaluate
from lumenpath.interp.values import text
from lumenpath.lang.errors import PathError
from lumenpath.operators.dynamic import native


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenpath")
    commands = parser.add_subparsers(dest="command", required=True)
    path = commands.add_parser("path")
    path.add_argument("expression")
    path.add_argument("file")
    path.add_argument("--json", action="store_true")
    path.add_argument("--spec", action="store_true")
    validate = commands.add_parser("validate")
    validate.add_argument("files", nargs="+")
    validate.add_argument("--definitions", required=True)
    validate.add_argument("--terminology")
    validate.add_argument("--strict", action="store_true")
    commands.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print("lumenpath 0.1")
        return 0
    if args.command == "path":
        document = sys.stdin.read() if args.file == "-" else Path(args.file).read_text()
        try:
            found = evaluate(args.expression, document, spec=args.spec)
        except PathError as error:
            print(f"{error.kind}: {error}", file=sys.stderr)
            return 1
        if args.json:
            print(json.dumps([native(x) for x in found], ensure_ascii=False))
        else:
            from lumenpath.operators.evaluate import lines

            print(lines([text(x) for x in found]))
        return 0
    return _validate(args)


def _validate(args) -> int:
    from lumenpath.rules.model import Options
    from lumenpath.rules.validate import Validator, valid
    from lumenpath.sources.definitions import Registry
    from lumenpath.sources.terminology import Terminology

    registry, terms = Registry(), None
    registry.load_folder(args.definitions)
    if args.terminology:
        terms = Terminology()
        terms.load_folder(args.terminology)
    validator, good = Validator(registry, Options(terminology=terms is not None, strict=args.strict), terms), True
    for file in args.files:
        found = validator.validate(Path(file).read_text())
        good = good and valid(found)
        for i in found:
            print(f"{file}: {i.severity} {i.code} {i.expression}: {i.diagnostics}")
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
