"""Print which queries cover each operator id: ``python -m obsim.catalog``."""

from __future__ import annotations

import re

from . import load


def main() -> None:
    queries = load().queries
    by_id: dict[str, list[str]] = {}
    for name, q in queries.items():
        for op in q.covers:
            by_id.setdefault(op, []).append(name if q.sql else f"{name} (rows only)")
    def order(op: str):
        family, rest = op.split("-")
        letter, number = re.match(r"([A-Z]?)(\d+)", rest).groups()
        return family, letter, int(number)
    print("# Operator coverage\n")
    print(f"{len(by_id)} operators, {len(queries)} queries, {sum(bool(q.sql) for q in queries.values())} with oracle SQL.")
    print("Written by `python -m obsim.catalog`.\n")
    print("| operator | queries |\n|---|---|")
    for op in sorted(by_id, key=order):
        print(f"| {op} | {', '.join(by_id[op])} |")


if __name__ == "__main__":
    main()
