"""Documents on the command line: ``python -m opweave (export | import | examine | merge) [FILE...]``; standard input and output stand in for files."""

from __future__ import annotations

import argparse
import base64
import json
import sys
from pathlib import Path

from .plans.transaction import Snapshot, import_json
from .sources import chunks


def _plain(v):
    return list(v) if isinstance(v, bytes) else {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else [_plain(x) for x in v] if isinstance(v, list) else v


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="opweave", description=__doc__)
    p.add_argument("action", choices=["export", "import", "examine", "merge"])
    p.add_argument("files", nargs="*")
    p.add_argument("-o", "--output")
    p.add_argument("--actor", default="00" * 16)
    p.add_argument("--skip-verifying-heads", action="store_true")
    a = p.parse_args(args)
    data = [Path(f).read_bytes() for f in a.files] or [sys.stdin.buffer.read()]
    if a.action == "import":
        out = chunks.encode_document([import_json(json.loads(data[0]), a.actor)])
    else:
        known = {c.hash: c for d in data for c in chunks.decode(d, verify=not a.skip_verifying_heads)}
        history = chunks._sorted_changes(list(known.values()))
        if a.action == "merge":
            out = chunks.encode_document(history)
        elif a.action == "export":
            out = json.dumps(_plain(Snapshot.of_changes(history).hydrate()), ensure_ascii=False).encode() + b"\n"
        else:
            rows = [chunks.change_row(0, c) for c in history]
            out = "".join(json.dumps(r, default=lambda v: base64.b64encode(v).decode() if isinstance(v, bytes) else str(v)) + "\n" for r in rows).encode()
    Path(a.output).write_bytes(out) if a.output else sys.stdout.buffer.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
