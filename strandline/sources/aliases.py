"""Path aliases of TypeScript projects: read from tsconfig files, applied to imports."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEEPEST = 8


def loose_json(text: str) -> dict:
    """JSON with comments and trailing commas; what still cannot be read counts as empty."""
    strings = r'"(?:[^"\\]|\\.)*"'
    bare = re.sub(rf"({strings})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    bare = re.sub(rf"({strings})|,(?=\s*[}}\]])", lambda m: m[1] or "", bare)
    try:
        out = json.loads(bare)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def aliases_of(configs: dict[str, str], start: str = "tsconfig.json") -> dict[str, str]:
    """pattern -> target, both with at most one star, relative to the root; a file's own settings go before those it extends."""
    paths, base, at, seen = {}, None, start, 0
    base_dir = ""
    while at in configs and seen < DEEPEST:
        seen += 1
        config = loose_json(configs[at])
        options = config.get("compilerOptions") or {}
        here = posixpath.dirname(at)
        if base is None and isinstance(options.get("baseUrl"), str):
            base = posixpath.normpath(posixpath.join(here, options["baseUrl"]))
        if not paths and isinstance(options.get("paths"), dict):
            paths, base_dir = options["paths"], here
        parent = config.get("extends")
        if not isinstance(parent, str):
            break
        at = posixpath.normpath(posixpath.join(here, parent if parent.endswith(".json") else f"{parent}.json"))
    root = base if base is not None else base_dir
    out = {}
    for pattern, targets in paths.items():
        if isinstance(targets, list) and targets and isinstance(targets[0], str):
            out[pattern] = posixpath.normpath(posixpath.join(root, targets[0])).removeprefix("./")
    if base is not None:
        out.setdefault("*", "*" if base in (".", "") else f"{base}/*")
    return out


def match_alias(path: str, aliases: dict[str, str]) -> str | None:
    """The file path that an import names, by the alias with the longest beginning."""
    for pattern in sorted(aliases, key=lambda p: (-len(p.split("*")[0]), p)):
        head, star, tail = pattern.partition("*")
        if path == pattern and not star:
            return aliases[pattern]
        if star and pattern != "*" and path.startswith(head) and path.endswith(tail) and len(path) >= len(head) + len(tail):
            return aliases[pattern].replace("*", path[len(head) : len(path) - len(tail)])
    return None


def read_aliases(spark: SparkSession, root: str) -> dict[str, str]:
    """The aliases of the root's tsconfig.json and what it extends; configuration files are few and small."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "tsconfig*.json").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    rows = files.filter((F.col("length") < 1_000_000) & ~F.col("path").contains("/node_modules/")).select("path", F.decode("content", "UTF-8").alias("text")).collect()
    return aliases_of({re.sub(r"^[a-z]+:/*", "/", r.path).removeprefix(base): r.text for r in rows})
