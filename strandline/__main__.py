"""Command line: crawl PATH STORE [--force] | status STORE | query STORE TOOL [NAME=VALUE ...] | serve STORE

serve answers one JSON request a line, {"tool": NAME, "args": {...}}, on standard input by one JSON line each.
"""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from strandline.config import limits
from strandline.sources.crawl import CrawlOptions
from strandline.sources.store import Store
from strandline.tools import PROMPT, call, prompt


def serve(store: Store, requests: TextIO, answers: TextIO) -> None:
    """One answer a request line; what is no request is answered with its error."""
    for line in filter(str.strip, requests):
        try:
            asked = json.loads(line)
            name, args = asked["tool"], asked.get("args") or {}
            if name == "crawl_project":
                out = {"ok": True, "rows": [store.crawl_project(**args)]}
            elif name == "clear_index":
                store.clear()
                out = {"ok": True, "rows": []}
            elif name == PROMPT:
                out = {"ok": True, "text": prompt(store.graph(), args["source"], args["target"])}
            else:
                out = call(store.graph(), name, **args)
                if out["ok"]:
                    out |= {k: [r.asDict(True) for r in out[k].collect()] for k in ("rows", "page") if k in out}
        except Exception as e:  # the next request must be answered whatever this one was
            out = {"ok": False, "error": f"{type(e).__name__}: {e}"[:500], "suggestions": []}
        print(json.dumps(out, default=str), file=answers, flush=True)


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("crawl", "status", "query", "serve"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    if argv[0] == "crawl":
        print(Store(spark, argv[2]).crawl_project(argv[1], CrawlOptions(force="--force" in argv, max_file_bytes=limits().max_file_bytes)))
    elif argv[0] == "serve":
        serve(Store(spark, argv[1]), sys.stdin, sys.stdout)
    elif argv[0] == "status":
        call(Store(spark, argv[1]).graph(), "index_status")["rows"].show()
    else:
        args = dict(a.split("=", 1) for a in argv[3:])
        out = call(Store(spark, argv[1]).graph(), argv[2], **{k: int(v) if v.isdigit() else v for k, v in args.items()})
        out["rows"].show(200, False) if out["ok"] else print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
