"""Print the SURVEY §2 coverage map: ID → registered queries (oracle or rows-only).

IDs are read from the first line of each query's docstring ("A5: …", "J1/U1: …").
"""

import os
import re
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans import ORACLES, QUERIES  # noqa: E402

ID = re.compile(r"\b([A-Z]{1,2})(\d{1,2})(?:-([A-Z]?)(\d{1,2}))?\b")


def ids_of(doc: str) -> list[str]:
    head = (doc or "").strip().split(":")[0]
    out = []
    for m in ID.finditer(head):
        p, a, p2, b = m.group(1), int(m.group(2)), m.group(3) or m.group(1), m.group(4)
        if b and p2 == p:
            out += [f"{p}{i}" for i in range(a, int(b) + 1)]
        else:
            out.append(f"{p}{a}")
    return out


def main():
    cov = defaultdict(list)
    for name, fn in QUERIES.items():
        for i in ids_of(fn.__doc__):
            cov[i].append(name + ("" if name in ORACLES else " (rows)"))
    key = lambda s: (re.match(r"[A-Z]+", s).group(0), int(re.search(r"\d+", s).group(0)))
    print("| ID | queries |\n|---|---|")
    for i in sorted(cov, key=key):
        print(f"| {i} | {', '.join(sorted(cov[i]))} |")


if __name__ == "__main__":
    main()
