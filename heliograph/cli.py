"""Command line: python -m heliograph.cli info [-v] FILE..., or extract FILE HDU TARGET. Neither needs Spark."""

from __future__ import annotations

import sys

from .functions.errors import FitsError
from .operators.catalog import file_text
from .operators.edit import extract

USAGE = __doc__


def run(args: list[str]) -> str:
    match args:
        case ["info", *rest] if rest:
            verbose = rest[0] in ("-v", "--verbose")
            paths = rest[verbose:]
            if paths:
                return "".join(file_text(p, verbose) for p in paths)
        case ["extract", path, which, target]:
            extract(path, which, target)
            return f"HDU {which} of {path} is in {target}\n"
    raise ValueError(USAGE)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
        return 0
    except (FitsError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
