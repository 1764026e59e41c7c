"""Secret scans by assignment-aware lexing.

Base patterns give spans of kind assign, access and hex. On top of them the whole text is lexed for name-literal pairs:
assignments of source code (typed ones and values on the next line too), configuration (quoted, bare and block
values), JSON, also with escaped quotes, elements and attributes of XML, call arguments and command-line options.
A value is a concatenation of literals and names. Names that take over other names' values make a graph along which
the best score of all names that a literal reaches comes back to it, to a fixed point, whatever the order in the
text; a literal counts as a secret (kind "lex") when that score plus its own randomness passes a threshold.

Every pattern is possessive, starts only where a name or quote does, and ends at the next quote, so that time grows
with the text's length whatever it holds. Null texts read as empty (no spans); repeated rows are each scanned; extra
columns are ignored; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices, text_column

# The base patterns, with either case of the ASCII letters spelt out.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "lex")

#: Weights of name parts; a literal needs SENSITIVE with its randomness added.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.6, "access": 0.4, "auth": 0.6, "key": 0.5, "signature": 0.5, "salt": 0.5, "bearer": 0.8, "session": 0.3, "cookie": 0.3,
}
SENSITIVE = 1.4
SHORTEST = 8

NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+"
#: Bare values are at most so long; longer runs are no values.
BARE = 2048
#: Literals; a backslash before both quotes is JSON within a string.
STRING = "|".join(
    [
        r'\\"(?:[^"\\\n]|\\(?!"))*+\\"',
        r'"""(?:[^"\\]|\\.|"(?!""))*+"""', r"'''(?:[^'\\]|\\.|'(?!''))*+'''",
        r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'", r"`(?:[^`\\]|\\.)*+`",
    ]
)
QUOTED = rf"(?:[rbufRBUF@$]{{1,2}}+(?=[\"'`]))?+(?P<string>{STRING})"
#: The left side of an assignment, up to the value.
HEAD = re.compile(rf"""(?:(?<![A-Za-z0-9_.])(?<![A-Za-z0-9_.]-)(?P<name>{NAME})|\\?["'](?P<key>[A-Za-z0-9_ .-]{{1,80}}+)\\?["'])\]?[ \t]{{0,40}}+(?:=>|:=|\+?=(?!=)|:(?![:/=]))""")
#: A declared type between the name and the value.
TYPED = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\]<>, |?*&]{0,60}?=(?![=>])(?=[ \t]*+[rbufRBUF@$]{0,2}+[\"'`])")
#: Names that are types where a name and a space stand before them.
TYPES = {"string", "str", "byte", "char", "text", "rune"}
BACK = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_]\w*+)[ \t]++\Z")
LEAD = re.compile(r"[ \t]*+(?:(?P<inside>[(\[{])[ \t]*+(?:\r?\n\s{0,200}+)?+(?=[A-Za-z@$]{0,2}+[\"'`])|\\?\r?\n[ \t]{0,200}+(?=[A-Za-z@$]{0,2}+[\"'`])|(?P<block>[|>][+-]?[ \t]*+\r?\n[ \t]++))?+")
ATOM = re.compile(rf"{QUOTED}|(?P<name>{NAME})(?![A-Za-z0-9_+/=@$%^&*!~#(\[-])|(?P<bare>[^\s,;\"'`<>(){{}}\[\]]{{1,{BARE}}}+)(?![^\s,;\"'`<>)}}\]])", re.S)
BLOCK = re.compile(r"[^\s]++(?=[ \t]*+(?:\r?\n|\Z))")
JOIN = re.compile(r"[ \t]*+(?:(?:\+|&|\.\.|\|\|)[ \t]*+(?:\\?\r?\n[ \t]*+)?+|\\\r?\n[ \t]*+|(?=[rbufRBUF]?[\"']))")
JOIN_INSIDE = re.compile(r"\s*+(?:(?:\+|&|\.\.|\|\|)\s*+|(?=[rbufRBUF]?[\"']))")
ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][\w.:-]*+)(?:\s[^<>]{0,500}+)?+>(?P<value>[^<>]++)</(?P=tag)>")
#: A name in one attribute, its value in the next or as the element's text.
ATTRIBUTES = re.compile(r"""(?<![\w.-])(?:name|key|id)[ \t]*+=[ \t]*+["'](?P<name>[A-Za-z0-9_ .-]{1,80}+)["'](?:\s++value[ \t]*+=[ \t]*+["'](?P<value>[^"'<>\n]*+)["']|[^<>"'\n]{0,80}+>(?P<text>[^<>]++)<)""")
CALL = re.compile(rf"""(?<![A-Za-z0-9_.-])(?P<name>{NAME})\([ \t]*+(?=["'])(?:["'](?P<key>[A-Za-z0-9_ .-]{{1,80}}+)["'][ \t]*+,[ \t]*+(?=["']))?+{QUOTED}""", re.S)
OPTION = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?P<value>[^\s,;\"'`<>(){}\[\]-][^\s,;\"'`<>(){}\[\]]*+)")
LINE_OF = re.compile(r"[ \t]*+(?:(?:export|set|const|let|var|ENV|ARG)[ \t]++)?+\Z")
REST = re.compile(r"[ \t]*+[,;]?[ \t]*+(?:(?:#|//)[^\n]*+)?(?:\r?\n|\Z)")
#: Bare values that refer to something: addresses, paths, templates.
REFERS = re.compile(r"[a-z]+://|[~.]*/|[$%{]")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> float:
    """How sensitive a target name is: its parts' weights, at most 1."""
    parts = [p.lower() for p in PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return min(1.0, sum(NAME_WEIGHTS.get(p, 0.0) for p in {*parts, *joined}))


def randomness(literal: str) -> float:
    """Shannon entropy of the characters over 4 bits, at most 1."""
    n = len(literal)
    return min(1.0, -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) / 4) if n else 0.0


Literal = tuple[int, int]


def inner(start: int, text: str) -> Literal:
    """The place of a string's contents, its quotes (one, three, or one with a backslash) taken off."""
    quote = 2 if text[0] == "\\" else 3 if text[:3] in ('"""', "'''") and len(text) >= 6 else 1
    return start + quote, start + len(text) - quote


def value_at(text: str, at: int, line_begins: bool) -> tuple[list[Literal], list[str]]:
    """Literals and names of the value that begins here; line_begins: nothing but the name stands before it in its line."""
    lead = LEAD.match(text, at)
    at, literals, names = lead.end(), [], []
    if lead["block"]:
        m = BLOCK.match(text, at)
        return ([m.span()] if m else []), []
    join = JOIN_INSIDE if lead["inside"] else JOIN
    while m := ATOM.match(text, at):
        if m["string"]:
            literals.append(inner(m.start("string"), m["string"]))
        elif m["name"] and (literals or names or not (whole := line_begins and REST.match(text, m.end()))):
            names.append(m["name"])
            if not literals and len(names) == 1 and any(c.isdigit() for c in m["name"]):
                literals.append(m.span("name"))
        elif m["name"]:  # a whole line: a constant's name or a value of letters only
            return [m.span("name")], [m["name"]]
        elif literals or names or REFERS.match(m["bare"]) or m["bare"].isalpha():
            break
        else:
            return [m.span("bare")], []
        more = join.match(text, m.end())
        if not more:
            break
        at = more.end()
    return literals, names


def pairs(text: str) -> Iterator[tuple[str, list[Literal], list[str]]]:
    """(name, literals, names) of everything that gives a name a value."""
    for m in HEAD.finditer(text):
        target, at = m["name"] or m["key"], m.end()
        if m["name"] and m["name"] in TYPES and (back := BACK.search(text, max(0, m.start() - 80), m.start())):
            target = back[1]
        if text[at - 1] == ":" and (typed := TYPED.match(text, at)):
            at = typed.end()
        begins = bool(m["name"]) and LINE_OF.match(text[max(0, text.rfind("\n", max(0, m.start() - 60), m.start()) + 1, m.start() - 60) : m.start()])
        yield target, *value_at(text, at, bool(begins))
    if "<" in text:
        for m in ELEMENT.finditer(text):
            yield m["tag"], [m.span("value")], []
        for m in ATTRIBUTES.finditer(text):
            yield m["name"], [m.span("value" if m["value"] is not None else "text")], []
    if "(" in text:
        for m in CALL.finditer(text):
            yield m["key"] or m["name"], [inner(m.start("string"), m["string"])], []
    if "--" in text:
        for m in OPTION.finditer(text):
            if not REFERS.match(m["value"]) and not m["value"].isalpha():
                yield m["name"], [m.span("value")], []


def lexed(text: str) -> list[Literal]:
    """Spans of literals that reach a sensitive name."""
    held: list[tuple[str, list[Literal]]] = []
    gives: dict[str, set[str]] = {}  # of a name those that it takes its value from
    for name, literals, names in pairs(text):
        name = name.removeprefix("self.").removeprefix("this.")
        if literals:
            held.append((name, literals))
        if names:
            gives.setdefault(name, set()).update(x.removeprefix("self.").removeprefix("this.") for x in names)
    if not held:
        return []
    score = {name: name_score(name) for name in {*gives, *(n for n, _ in held)}}
    best: dict[str, float] = {}
    for name in sorted(score, key=lambda n: (-score[n], n)):  # the most sensitive first: each name is reached once
        todo = [name] if score[name] > 0 and name not in best else []
        while todo:
            at = todo.pop()
            if at not in best:
                best[at] = score[name]
                todo += gives.get(at, ())
    found = set()
    for name, literals in held:
        value = "".join(text[a:b] for a, b in literals)
        if name in best and len(value) >= SHORTEST and best[name] + randomness(value) * (0.3 if any(c.isspace() for c in value.strip()) else 1) >= SENSITIVE:
            found.update((a, b) for a, b in literals if b > a)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches per kind, failing lengths dropped."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    count = Counter(k for _, _, k in base)
    spans = base + [(s, e, "lex") for s, e in lexed(text)]
    return count["assign"], count["access"], count["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for part in slices(batches):
            rows = list(zip(*map(scan_text, part.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, kinds[1:]))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(scan, schema)
