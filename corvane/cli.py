"""python -m corvane.cli validate|compile|canonicalize|embed|visualize SPEC [PATH]"""

from __future__ import annotations

import os
import sys

from .plans.search import InvalidArgument
from .sources.spec import Spec
from .sources.vectors import CONTRACTS, LAYOUT, MANIFEST


def main(args: list[str]) -> int:
    if not 2 <= len(args) <= 3 or args[0] not in ("validate", "compile", "canonicalize", "embed", "visualize"):
        print(__doc__, file=sys.stderr)
        return 2
    command, source, *rest = args
    try:
        with open(source, encoding="utf-8") as file:
            spec = Spec.read(file.read())
    except (OSError, InvalidArgument) as error:
        print(error, file=sys.stderr)
        return 1
    if command == "compile":
        folder = rest[0] if rest else "."
        os.makedirs(folder, exist_ok=True)
        for name, text in ((MANIFEST, spec.manifest()), (CONTRACTS, spec.contracts()), (LAYOUT, spec.layout_json())):
            with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
                file.write(text)
    elif command != "validate":
        data = {"canonicalize": lambda: spec.manifest().encode(), "embed": spec.payload, "visualize": lambda: spec.dot().encode()}[command]()
        if rest:
            with open(rest[0], "wb") as file:
                file.write(data)
        else:
            sys.stdout.buffer.write(data)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
