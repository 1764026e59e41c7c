"""Java and TypeScript sources to declarations and call sites, by a tokeniser and a scope stack.

There is no grammar here: declarations are recognised by their shape before a brace, so that odd or broken files
still give what can be told. Generics are skipped over; comments and strings never count as code.
"""

from __future__ import annotations

import re

from strandline.sources.aliases import match_alias
from strandline.sources.rules import ADVICE_ANNOTATIONS, BEAN_ANNOTATIONS, ENTRY_ANNOTATIONS, INJECT_ANNOTATIONS, PROXY_ANNOTATIONS, REFLECTIVE_CALLS, ROUTE_ANNOTATIONS, ROUTE_PREFIX_ANNOTATIONS, ROUTER_METHODS

TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"{3}.*?\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|\.\.\.|\?\.|&&|\|\||.)""", re.S)
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}
MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "async", "readonly", "export", "declare", "override", "get", "set", "transient", "volatile", "sealed"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "throw", "new", "synchronized", "function", "typeof", "await", "super", "constructor", "do", "else", "try", "assert", "import", "in", "of", "instanceof", "delete", "void", "yield", "case"}
FLOW = {"if": "branch", "else": "branch", "switch": "branch", "for": "loop", "while": "loop", "do": "loop", "try": "exception", "catch": "exception"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token:
    __slots__ = ("kind", "text", "line")

    def __init__(self, kind: str, text: str, line: int):
        self.kind, self.text, self.line = kind, text, line


def tokens(text: str) -> list[Token]:
    out, line = [], 0
    for m in TOKEN.finditer(text):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line))
        line += m.group().count("\n")
    return out


def plain_type(words: list[str]) -> str | None:
    """A type's name without arguments, arrays, null and wrappers."""
    text = "".join(words).replace("readonly", "").replace("final", "")
    m = re.match(r"(?:Optional|List|Set|Collection|Array|Promise|Observable|ReadonlyArray)<([^<>]*).*", text)
    text = m[1] if m else text
    text = re.sub(r"<.*", "", text.split("|")[0].split("&")[0]).rstrip("[]?. ")
    return text or None


def split_commas(part: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in part:
        depth += (t.text in ("(", "[", "{", "<")) - (t.text in (")", "]", "}", ">"))
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


class Reader:
    def __init__(self, text: str, module: str, java: bool, aliases: dict[str, str] | None = None):
        self.t, self.java, self.module, self.aliases = tokens(text), java, module, aliases or {}
        self.match = self._brackets()
        self.package = ""
        self.out = {k: [] for k in ("imports", "types", "methods", "fields", "calls", "routes", "injections", "reflections")}
        self.field_types: dict[str, dict[str, str]] = {}
        self.prefix: dict[str, str] = {}

    def _brackets(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in CLOSE and stack:
                out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.t)
        return out

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[min(i, len(self.t) - 1)].line if self.t else 0

    # -- annotations before a declaration

    def notes_at(self, i: int) -> tuple[list[dict], int]:
        notes = []
        while self.word(i) == "@" and self.word(i + 1) != "interface":
            line, name, j = self.line(i), self.word(i + 1), i + 2
            while self.word(j) == ".":
                name, j = f"{name}.{self.word(j + 1)}", j + 2
            args = []
            if self.word(j) == "(":
                end = self.match.get(j, j)
                args = ["".join(t.text for t in p) for p in split_commas(self.t[j + 1 : end])]
                j = end + 1
            notes.append({"name": name, "arguments": args, "line": line})
            i = j
        return notes, i

    def skip_generic(self, i: int) -> int:
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += (self.word(i) == "<") - (self.word(i) == ">")
            i += 1
            if depth == 0:
                break
        return i

    # -- file level

    def read(self) -> dict:
        self.members(0, len(self.t), None)
        return {"package": self.package, "module_id": self.module, **self.out}

    def type_id(self, name: str, owner: str | None) -> str:
        base = owner or (self.package if self.java else self.module)
        return f"{base}.{name}" if base else name

    def import_at(self, i: int) -> int:
        end = i
        while end < len(self.t) and self.word(end) != ";" and self.line(end) - self.line(i) < 60:
            if not self.java and self.t[end].kind == "text":
                end += 1
                break
            end += 1
        part = self.t[i + 1 : end]
        words = [t.text for t in part]
        if self.java:
            name = "".join(w for w in words if w != "static")
            self.out["imports"].append({"fqn": name, "simple_name": name.rpartition(".")[2], "module": name.rpartition(".")[0], "imported_name": name.rpartition(".")[2]})
        elif part and part[-1].kind == "text":
            module = self.resolve_module(part[-1].text[1:-1])
            names = words[: words.index("from")] if "from" in words else []
            if "*" in names:
                self.out["imports"].append({"fqn": module, "simple_name": names[-1], "module": module, "imported_name": None})
            else:
                inner = False
                k = 0
                while k < len(names):
                    w = names[k]
                    inner = inner or w == "{"
                    if re.match(r"[A-Za-z_$]", w) and w not in ("type", "as"):
                        alias = names[k + 2] if k + 2 < len(names) and names[k + 1] == "as" else w
                        self.out["imports"].append({"fqn": f"{module}.{w}" if inner else f"{module}.default", "simple_name": alias, "module": module, "imported_name": w if inner else "default"})
                        k += 2 if alias != w else 0
                    k += 1
        return end

    def resolve_module(self, path: str) -> str:
        if not path.startswith("."):
            target = match_alias(path, self.aliases)
            return path if target is None else re.sub(r"\.[cm]?[jt]sx?$", "", target).strip("/").replace("/", ".").removesuffix(".index")
        base = self.module.split(".")[:-1]
        for part in path.split("/"):
            if part == "..":
                base = base[:-1]
            elif part not in (".", ""):
                base.append(re.sub(r"\.[cm]?[jt]sx?$", "", part))
        return ".".join(base).removesuffix(".index")

    def members(self, i: int, end: int, owner: str | None) -> None:
        """Declarations between i and end, of a type or of the file."""
        while i < end:
            if owner is None and self.word(i) == "package" and self.java:
                j = i + 1
                while self.word(j) not in (";", ""):
                    self.package += self.word(j)
                    j += 1
                i = j + 1
                continue
            if owner is None and self.word(i) == "import" and self.word(i + 1) not in ("(", "."):
                i = self.import_at(i) + 1
                continue
            start = i
            notes, i = self.notes_at(i)
            mods = []
            while self.word(i) in MODIFIERS and self.word(i + 1) not in ("(", "=", ":", ";"):
                mods.append(self.word(i))
                i += 1
            more, i = self.notes_at(i)
            notes += more
            if self.word(i) == "default" and not self.java:
                i += 1
            if self.word(i) == "@" and self.word(i + 1) == "interface":
                i = self.type_at(i + 1, start, "annotation_type", notes, mods, owner)
            elif self.word(i) in TYPE_WORDS and self.t[min(i + 1, len(self.t) - 1)].kind == "word" and (self.word(i) != "record" or self.java):
                i = self.type_at(i, start, TYPE_WORDS[self.word(i)], notes, mods, owner)
            elif not self.java and owner is None and self.word(i) == "type" and self.t[min(i + 1, len(self.t) - 1)].kind == "word":
                self.out["types"].append({"id": self.type_id(self.word(i + 1), None), "kind": "interface", "name": self.word(i + 1), "parents": [], "interfaces": [], "start_line": self.line(i), "end_line": self.line(i), "annotations": []})
                i = self.statement_end(i, end)
            elif not self.java and self.word(i) == "function":
                k = i + 2 if self.word(i + 1) == "*" else i + 1
                i = self.method_at(k, start, notes, mods, owner) or k + 1
            elif not self.java and owner is None and self.word(i) in ("const", "let", "var"):
                i = self.variable_at(i, start, mods, end)
            elif owner is None and not self.java:
                stop = self.statement_end(i, end)
                self.body(i, stop, None, None, {})
                i = max(stop, i + 1)
            elif owner is not None:
                i = self.member_at(i, start, notes, mods, owner, end)
            else:
                i += 1

    def statement_end(self, i: int, end: int) -> int:
        while i < end:
            if self.word(i) in OPEN:
                i = self.match.get(i, end)
            elif self.word(i) == ";":
                return i + 1
            elif i + 1 < end and self.line(i + 1) > self.line(i) and self.word(i) not in (",", "=", ".", "=>", "|", "&", "&&", "||", "?", ":", "+") and self.word(i + 1) not in (".", "?", ":", "|", "&", "&&", "||", "?."):
                return i + 1
            i += 1
        return end

    def type_at(self, i: int, start: int, kind: str, notes: list[dict], mods: list[str], owner: str | None) -> int:
        record = self.word(i) == "record"
        name = self.word(i + 1)
        me = self.type_id(name, owner)
        j = self.skip_generic(i + 2)
        components = []
        if record and self.word(j) == "(":
            components = split_commas(self.t[j + 1 : self.match.get(j, j)])
            j = self.match.get(j, j) + 1
        parents, interfaces, into = [], [], None
        while j < len(self.t) and self.word(j) != "{":
            if self.word(j) in ("extends", "implements"):
                into = interfaces if self.word(j) == "implements" else parents
                j += 1
            elif self.t[j].kind == "word" and into is not None:
                text, j = self.word(j), j + 1
                while self.word(j) == ".":
                    text, j = f"{text}.{self.word(j + 1)}", j + 2
                into.append(text)
                j = self.skip_generic(j)
            elif self.word(j) == ";":
                break
            else:
                j += 1
        stop = self.match.get(j, j)
        if any(n["name"] == "Aspect" for n in notes):
            kind = "aspect"
        self.out["types"].append({"id": me, "kind": kind, "name": name, "parents": parents, "interfaces": interfaces, "start_line": self.line(start), "end_line": self.line(stop), "annotations": notes})
        self.field_types[me] = {}
        self.prefix[me] = next((self.literal(n["arguments"]) for n in notes if n["name"] in ROUTE_PREFIX_ANNOTATIONS and n["arguments"]), "")
        for c in components:
            words = [t.text for t in c if t.text != "@"]
            self.field(me, words[-1], plain_type(words[:-1]), c[0].line, ["private", "final"], [])
        inner = j + 1
        if kind == "enum" and self.java:
            while inner < stop and self.word(inner) != ";":
                inner = self.match.get(inner, inner) + 1 if self.word(inner) in OPEN else inner + 1
        before = len(self.out["methods"])
        self.members(inner, stop, me)
        declared = {m["name"] for m in self.out["methods"][before:] if m["type_id"] == me}
        for c in components:
            words = [t.text for t in c]
            if words[-1] not in declared:
                self.add_method(me, words[-1], [], c[0].line, c[0].line, plain_type(words[:-1]), ["public"], [], False)
        ctors = [m for m in self.out["methods"][before:] if m["type_id"] == me and m["is_constructor"]]
        bean = any(n["name"] in BEAN_ANNOTATIONS for n in notes)
        for m in ctors:
            if bean and len(ctors) == 1 or any(n["name"] in INJECT_ANNOTATIONS for n in m["annotations"]):
                self.out["injections"] += [{"owner_id": me, "name": p["name"], "type": p["type"], "framework": "spring" if self.java else "nestjs", "line": m["start_line"]} for p in m["params"] if p["type"]]
        return stop + 1

    def field(self, owner: str, name: str, kind: str | None, line: int, mods: list[str], notes: list[dict]) -> None:
        self.field_types[owner][name] = kind or ""
        self.out["fields"].append({"id": f"{owner}${name}", "type_id": owner, "name": name, "type": kind, "start_line": line, "modifiers": mods, "annotations": notes})
        framework = next((INJECT_ANNOTATIONS[n["name"]] for n in notes if n["name"] in INJECT_ANNOTATIONS), None)
        if framework:
            self.out["injections"].append({"owner_id": owner, "name": name, "type": kind, "framework": framework, "line": line})

    def member_at(self, i: int, start: int, notes: list[dict], mods: list[str], owner: str, end: int) -> int:
        """A method or field of a type."""
        if self.word(i) == "{":
            self.body(i + 1, self.match.get(i, end), owner, None, {})
            return self.match.get(i, end) + 1
        if self.word(i) in (";", ","):
            return i + 1
        j = self.skip_generic(i)
        k = j
        while k < end and self.word(k) not in ("(", "=", ";", "{", ":"):
            k = self.skip_generic(k) if self.word(k) == "<" else k + 1
        if self.word(k) == "(":
            return self.method_at(k - 1 if self.t[k - 1].kind == "word" else j, start, notes, mods, owner, returned=self.t[j : k - 1]) or k + 1
        if self.java:
            words = self.t[j:k]
            stop = self.statement_end_java(k, end)
            if len(words) >= 2:
                self.field(owner, words[-1].text, plain_type([t.text for t in words[:-1]]), self.line(i), mods, notes)
            self.body(k, stop, owner, None, {})
            return stop + 1
        name = self.word(i)
        stop = self.statement_end(i, end)
        kind, arrow = None, next((x for x in range(k, stop) if self.word(x) == "=>"), None)
        if self.word(k) == ":":
            e = k + 1
            while e < stop and self.word(e) not in ("=", ";"):
                e += 1
            kind = plain_type([t.text for t in self.t[k + 1 : e]])
        if arrow is not None and self.word(k) == "=":
            opening = next((x for x in range(k, arrow) if self.word(x) == "("), None)
            params = self.params(opening) if opening is not None else []
            m = self.add_method(owner, name, params, self.line(start), self.line(stop - 1), None, mods, notes, False)
            self.body(arrow + 1, stop, owner, m["id"], {p["name"]: p["type"] for p in params if p["type"]})
        elif re.match(r"[A-Za-z_$#]", name or ""):
            value = self.word(k + 2) if self.word(k) == "=" and self.word(k + 1) == "new" else None
            self.field(owner, name, kind or value, self.line(i), mods, notes)
            self.body(k, stop, owner, None, {})
        return max(stop, i + 1)

    def statement_end_java(self, i: int, end: int) -> int:
        while i < end and self.word(i) != ";":
            i = self.match.get(i, end) if self.word(i) in OPEN else i + 1
            if self.word(i) in CLOSE:
                i += 1
        return i

    def params(self, i: int) -> list[dict]:
        out = []
        for part in split_commas(self.t[i + 1 : self.match.get(i, i)]):
            words, k = [t.text for t in part], 0
            while k < len(words) and words[k] == "@":
                k += 2
                if k < len(words) and words[k] == "(":
                    depth = 0
                    while k < len(words):
                        depth += (words[k] == "(") - (words[k] == ")")
                        k += 1
                        if not depth:
                            break
            words = [w for w in words[k:] if w not in MODIFIERS]
            held = [w for w in (t.text for t in part) if w in ("private", "public", "protected", "readonly")]
            if not words:
                continue
            if self.java:
                out.append({"name": words[-1], "type": plain_type([w for w in words[:-1] if w != "..."]), "variadic": "..." in words})
            else:
                name = words[1] if words[0] == "..." and len(words) > 1 else words[0]
                at = words.index(":") if ":" in words else None
                stop = words.index("=") if "=" in words else len(words)
                out.append({"name": name, "type": plain_type(words[at + 1 : stop]) if at is not None and at < stop else None, "variadic": words[0] == "...", "optional": "?" in words or "=" in words, "property": bool(held)})
        return out

    def add_method(self, owner: str | None, name: str, params: list[dict], start: int, end: int, returned: str | None, mods: list[str], notes: list[dict], ctor: bool) -> dict:
        base = owner or f"module:{self.module}"
        me = f"{base}#{'<init>' if ctor else name}"
        ids = {m["id"] for m in self.out["methods"]}
        if me in ids:
            me = f"{me}({','.join(p['type'] or '' for p in params)})"
            n = 2
            while me in ids:
                me, n = f"{me.split(')#')[0].rstrip(')')})#{n}", n + 1
        advice = next(((n["name"], self.literal(n["arguments"])) for n in notes if n["name"] in ADVICE_ANNOTATIONS), (None, None)) if owner and any(t["id"] == owner and t["kind"] == "aspect" for t in self.out["types"]) else (None, None)
        entry = next((ENTRY_ANNOTATIONS[n["name"]] for n in notes if n["name"] in ENTRY_ANNOTATIONS), None)
        if name == "main" and self.java and "static" in mods:
            entry = entry or "cli"
        proxies = [PROXY_ANNOTATIONS[n["name"]] for n in notes if n["name"] in PROXY_ANNOTATIONS]
        m = {"id": me, "type_id": base, "name": "<init>" if ctor else name, "is_constructor": ctor, "params": params, "variadic": any(p.get("variadic") for p in params), "optional": sum(bool(p.get("optional")) for p in params), "start_line": start, "end_line": end, "return_type": returned, "modifiers": mods, "annotations": notes, "advice_kind": advice[0], "pointcut": advice[1], "proxies": proxies, "entry_kind": entry}
        self.out["methods"].append(m)
        for n in notes:
            if n["name"] in ROUTE_ANNOTATIONS and owner:
                framework, verb = ROUTE_ANNOTATIONS[n["name"]]
                text = " ".join(n["arguments"])
                verb = verb or next((v for v in ("GET", "POST", "PUT", "DELETE", "PATCH") if f"RequestMethod.{v}" in text), "GET")
                path = "/" + "/".join(x.strip("/") for x in (self.prefix.get(owner, ""), self.literal(n["arguments"])) if x.strip("/"))
                self.out["routes"].append({"framework": framework, "http_method": verb, "path": path, "handler": me, "line": n["line"]})
                m["entry_kind"] = "http"
        return m

    def literal(self, args: list[str]) -> str:
        m = re.search(r"""["'`]((?:[^"'`\\]|\\.)*)["'`]""", " ".join(args))
        return m[1] if m else ""

    def method_at(self, i: int, start: int, notes: list[dict], mods: list[str], owner: str | None, returned: list[Token] = ()) -> int | None:
        """A method whose name is at i; where to go on, or None if it is none."""
        j = self.skip_generic(i + 1)
        if self.word(j) != "(" or self.t[min(i, len(self.t) - 1)].kind != "word":
            return None
        params, name = self.params(j), self.word(i)
        simple = owner.rpartition(".")[2] if owner else None
        ctor = name == "constructor" if not self.java else name == simple and not returned
        k = self.match.get(j, j) + 1
        kind = plain_type([t.text for t in returned]) if returned else None
        begin = k
        while k < len(self.t) and self.word(k) not in ("{", ";"):
            if self.word(k) in ("(", "["):
                k = self.match.get(k, k)
            if not self.java and k > begin and self.line(k) > self.line(k - 1) and self.word(k - 1) not in (":", "|", "&", ","):
                break
            k += 1
        if not self.java and self.word(begin) == ":":
            kind = plain_type([t.text for t in self.t[begin + 1 : k]])
        has_body = self.word(k) == "{"
        stop = self.match.get(k, k) if has_body else k
        m = self.add_method(owner, name, params, self.line(start), self.line(min(stop, len(self.t) - 1)), kind, mods, notes, ctor)
        for p in params:
            if p.pop("property", False) and owner:
                self.field(owner, p["name"], p["type"], self.line(start), [], [])
        if has_body:
            self.body(k + 1, stop, owner, m["id"], {p["name"]: p["type"] for p in params if p["type"]})
        return (stop if has_body else k - 1 if self.word(k) != ";" else k) + 1

    def variable_at(self, i: int, start: int, mods: list[str], end: int) -> int:
        """A file-level variable; one that holds a function is a method."""
        name, stop = self.word(i + 1), self.statement_end(i, end)
        eq = next((x for x in range(i, stop) if self.word(x) == "="), None)
        arrow = next((x for x in range(i, stop) if self.word(x) in ("=>", "function")), None)
        if eq is not None and arrow is not None and self.word(eq + 1) in ("(", "async", "function") :
            opening = next((x for x in range(eq, stop) if self.word(x) == "("), eq)
            params = self.params(opening)
            m = self.add_method(None, name, params, self.line(start), self.line(stop - 1), None, mods, [], False)
            self.body(self.match.get(opening, opening) + 1, stop, None, m["id"], {p["name"]: p["type"] for p in params if p["type"]})
        else:
            self.body(i, stop, None, None, {})
        return max(stop, i + 2)

    # -- bodies

    def body(self, i: int, end: int, owner: str | None, method: str | None, known: dict[str, str]) -> None:
        flow: list[tuple[int, str, str]] = []
        known = dict(known)
        base = owner or f"module:{self.module}"
        while i < end:
            flow = [f for f in flow if f[0] > i]
            t, w = self.t[i], self.word(i)
            if t.kind != "word":
                i += 1
                continue
            if w in FLOW:
                k, guard = i + 1, ""
                if self.word(k) == "(":
                    guard = " ".join(x.text for x in self.t[k + 1 : self.match.get(k, k)])[:160]
                    k = self.match.get(k, k) + 1
                stop = self.match.get(k, k) if self.word(k) == "{" else self.statement_end_java(k, end) if self.java else self.statement_end(k, end)
                flow.append((stop, FLOW[w], guard))
            made = w == "new"
            if made:
                i += 1
                w = self.word(i)
                while self.word(i + 1) == ".":
                    i += 2
                    w = f"{w}.{self.word(i)}"
            # a declaration: Type name = ..., const name: Type = ..., const name = new Type(...)
            if not made and self.word(i - 1) not in (".", "?.", "new"):
                k = self.skip_generic(i + 1)
                if self.java and w[:1].isupper() and self.t[min(k, len(self.t) - 1)].kind == "word" and self.word(k + 1) in ("=", ";", ":") and self.word(k) not in ("instanceof",):
                    known[self.word(k)] = plain_type([w])
                if w in ("const", "let", "var") and self.word(i + 2) == ":":
                    known[self.word(i + 1)] = plain_type([self.word(i + 3)])
                if w in ("const", "let", "var") and self.word(i + 2) == "=" and self.word(i + 3) == "new":
                    known[self.word(i + 1)] = plain_type([self.word(i + 4)])
            after = self.skip_generic(i + 1) if self.word(i + 1) == "<" and w[:1].isupper() else i + 1
            if self.word(after) == "(" and (made or w not in NOT_CALLS or w == "super"):
                self.call(i, after, w, made, base, owner, method, known, flow)
            i += 1

    def call(self, i: int, at: int, name: str, made: bool, base: str, owner: str | None, method: str | None, known: dict[str, str], flow: list) -> None:
        args = ["".join(x.text for x in p) for p in split_commas(self.t[at + 1 : self.match.get(at, at)])]
        receiver, kind = None, None
        if not made and self.word(i - 1) in (".", "?."):
            j = i - 2
            if self.word(j) == ")":
                opening = next((a for a, b in self.match.items() if b == j), j)
                made_type = self.word(opening - 1) if self.word(opening - 2) == "new" else None
                receiver = f"new {made_type}()" if made_type else f"{self.word(opening - 1)}()"
                kind = f"new:{made_type}" if made_type else None
            elif self.t[j].kind == "word":
                parts = [self.word(j)]
                while self.word(j - 1) in (".", "?.") and self.t[j - 2].kind == "word":
                    j -= 2
                    parts.insert(0, self.word(j))
                receiver = ".".join(parts)
                if receiver in ("this", "super"):
                    kind = base if receiver == "this" else "super"
                elif parts[0] == "this" and len(parts) == 2 and owner:
                    kind = self.field_types.get(owner, {}).get(parts[1]) or None
                elif len(parts) == 1:
                    kind = known.get(receiver) or self.field_types.get(owner or "", {}).get(receiver) or (receiver if receiver[:1].isupper() else None)
                elif parts[-1][:1].isupper():
                    kind = receiver
        kinds = list(dict.fromkeys(f[1] for f in flow))
        if name == "super":
            name, kind, receiver, made = "<init>", "super", "super", False
        self.out["calls"].append({"line": self.line(i), "receiver": receiver, "receiver_type": kind, "name": name, "arguments": args, "type_id": base, "method_id": method, "is_constructor": made, "control_flow": kinds, "guards": list(dict.fromkeys(f[2] for f in flow if f[2]))[:3]})
        if name in REFLECTIVE_CALLS and args:
            self.out["reflections"].append({"owner_id": method or base, "target_kind": REFLECTIVE_CALLS[name], "target": self.literal(args[:1]) or None, "line": self.line(i)})
        if not self.java and receiver and name in ROUTER_METHODS and len(args) >= 2 and args[0][:1] in "'\"`" and args[0][1:2] == "/":
            handler = args[-1] if re.fullmatch(r"[\w$.]+", args[-1]) else None
            inline = f"{base}#<anonymous@{self.line(i) + 1}>"
            if handler is None:
                self.add_method(owner, f"<anonymous@{self.line(i) + 1}>", [], self.line(i), self.line(self.match.get(at, at)), None, [], [], False)["entry_kind"] = "http"
            self.out["routes"].append({"framework": "express", "http_method": name.upper(), "path": self.literal(args[:1]), "handler": handler or inline, "line": self.line(i)})


def parse(text: str, module: str, language: str, aliases: dict[str, str] | None = None) -> dict:
    return Reader(text, module, language == "java", aliases).read()
