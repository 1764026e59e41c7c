"""Python sources to declarations and call sites, by the standard library's syntax tree."""

from __future__ import annotations

import ast

from strandline.sources.rules import ENTRY_ANNOTATIONS, REFLECTIVE_CALLS, ROUTER_METHODS

FLOW = {ast.If: "branch", ast.IfExp: "predicate", ast.For: "loop", ast.While: "loop", ast.AsyncFor: "loop", ast.Try: "exception", ast.Match: "branch"}


def _name(node: ast.AST | None) -> str:
    return "" if node is None else ast.unparse(node)


def _type_text(node: ast.AST | None) -> str | None:
    """The class behind an annotation: containers and optionals are unwrapped."""
    if node is None:
        return None
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value.strip("'\" ")
    if isinstance(node, ast.BinOp):
        return _type_text(node.left) if _name(node.left) != "None" else _type_text(node.right)
    if isinstance(node, ast.Subscript):
        inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) and node.slice.elts else node.slice
        return _type_text(inner) if _name(node.value).split(".")[-1] in ("Optional", "Annotated", "Final", "ClassVar", "Type", "type") else _name(node.value)
    return _name(node)


class Reader(ast.NodeVisitor):
    def __init__(self, module: str, package: bool = False):
        self.module, self.package = module, package
        self.out = {k: [] for k in ("imports", "types", "methods", "fields", "calls", "routes", "injections", "reflections")}
        self.types: list[str] = []
        self.method: str | None = None
        self.flow: list[tuple[str, str]] = []
        self.known: dict[str, str] = {}
        self.fields: dict[str, dict[str, str]] = {}

    # -- names

    @property
    def owner(self) -> str:
        return self.types[-1] if self.types else f"module:{self.module}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out["imports"].append({"fqn": a.name, "simple_name": a.asname or a.name.split(".")[0], "module": a.name, "imported_name": None})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            up = [x for x in self.module.split(".") if x]
            up = up[: len(up) - node.level + self.package]  # a package's own file is in the package
            base = ".".join([*up, *([base] if base else [])])
        for a in node.names:
            self.out["imports"].append({"fqn": f"{base}.{a.name}" if base else a.name, "simple_name": a.asname or a.name, "module": base, "imported_name": a.name})

    # -- declarations

    def _annotations(self, node) -> list[dict]:
        out = []
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            out.append({"name": _name(call.func if call else d), "arguments": [_name(a) for a in call.args] + [f"{k.arg}={_name(k.value)}" for k in call.keywords] if call else [], "line": d.lineno - 1})
        return out

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        me = f"{self.owner}.{node.name}" if self.types else f"{self.module}.{node.name}"
        bases = [b for b in (_type_text(b) for b in node.bases) if b]
        self.out["types"].append({"id": me, "kind": "class", "name": node.name, "parents": bases, "interfaces": [], "start_line": node.lineno - 1, "end_line": node.end_lineno - 1, "annotations": self._annotations(node)})
        self.fields[me] = {}
        self.types.append(me)
        method, self.method = self.method, None
        for child in node.body:
            if isinstance(child, (ast.AnnAssign, ast.Assign)):
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        self._field(me, t.id, _type_text(child.annotation) if isinstance(child, ast.AnnAssign) else None, child.lineno)
            self.visit(child)
        self.method = method
        self.types.pop()

    def _field(self, owner: str, name: str, kind: str | None, line: int) -> None:
        if name not in self.fields[owner]:
            self.out["fields"].append({"id": f"{owner}${name}", "type_id": owner, "name": name, "type": kind, "start_line": line - 1})
        if kind or name not in self.fields[owner]:
            self.fields[owner][name] = kind or ""

    def _function(self, node) -> None:
        ctor = bool(self.types) and node.name == "__init__"
        name = "<init>" if ctor else node.name
        me = f"{self.owner}#{name}"
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        params = [{"name": a.arg, "type": _type_text(a.annotation)} for a in args if a.arg not in ("self", "cls")]
        notes = self._annotations(node)
        entry = next((ENTRY_ANNOTATIONS[n["name"].split(".")[-1]] for n in notes if n["name"].split(".")[-1] in ENTRY_ANNOTATIONS), None)
        for n in notes:
            base, _, verb = n["name"].rpartition(".")
            if base and verb in ROUTER_METHODS and n["arguments"] and n["arguments"][0][:1] in "'\"":
                verbs = [verb.upper()] if verb not in ("route",) else ["GET"]
                for a in n["arguments"]:
                    if verb == "route" and a.startswith("methods="):
                        verbs = [v.strip("'\" ").upper() for v in a[8:].strip("[]()").split(",") if v.strip()]
                self.out["routes"] += [{"framework": "python", "http_method": v, "path": ast.literal_eval(n["arguments"][0]), "handler": me, "line": node.lineno - 1} for v in verbs]
                entry = "http"
        if node.name.startswith("test_") or node.name.startswith("test") and self.types and self.types[-1].rpartition(".")[2].startswith("Test"):
            entry = entry or "test"
        self.out["methods"].append(
            {"id": me, "type_id": self.owner, "name": name, "is_constructor": ctor, "params": params, "variadic": bool(node.args.vararg or node.args.kwarg), "start_line": node.lineno - 1, "end_line": node.end_lineno - 1}
            | {"return_type": _type_text(node.returns), "modifiers": ["async"] if isinstance(node, ast.AsyncFunctionDef) else [], "annotations": notes, "entry_kind": entry, "optional": len(node.args.defaults) + sum(d is not None for d in node.args.kw_defaults)}
        )
        for a, default in zip(reversed(args), reversed(node.args.defaults)):
            if isinstance(default, ast.Call) and _name(default.func).split(".")[-1] in ("Depends", "Security") and default.args:
                self.out["injections"].append({"owner_id": me, "name": a.arg, "type": _name(default.args[0]), "framework": "fastapi", "line": node.lineno - 1})
        known, method, flow = self.known, self.method, self.flow
        self.known = {**(known if method else {}), **{p["name"]: p["type"] for p in params if p["type"]}}
        self.method, self.flow = me, []
        for child in node.body:
            self.visit(child)
        self.known, self.method, self.flow = known, method, flow

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    # -- bodies

    def _assigned(self, target: ast.AST, value: ast.AST | None, kind: str | None) -> None:
        if kind is None and isinstance(value, ast.Call) and _name(value.func).split(".")[-1][:1].isupper():
            kind = _name(value.func)
        if kind is None and isinstance(value, ast.Name):
            kind = self.known.get(value.id)
        if isinstance(target, ast.Name) and kind:
            self.known[target.id] = kind
        if isinstance(target, ast.Attribute) and _name(target.value) == "self" and self.types:
            self._field(self.types[-1], target.attr, kind, target.lineno)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.generic_visit(node)
        if self.method:
            for t in node.targets:
                self._assigned(t, node.value, None)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.generic_visit(node)
        if self.method:
            self._assigned(node.target, node.value, _type_text(node.annotation))

    def visit_With(self, node: ast.With) -> None:
        for i in node.items:
            if i.optional_vars is not None and self.method:
                self._assigned(i.optional_vars, i.context_expr, None)
        self.generic_visit(node)

    def generic_visit(self, node: ast.AST) -> None:
        kind = FLOW.get(type(node))
        if kind:
            guard = node.test if hasattr(node, "test") else getattr(node, "iter", None)
            self.flow.append((kind, _name(guard)[:160]))
        super().generic_visit(node)
        if kind:
            self.flow.pop()

    def _receiver_type(self, node: ast.AST) -> str | None:
        text = _name(node)
        if text in ("self", "cls") and self.types:
            return self.types[-1]
        if isinstance(node, ast.Call):
            return _name(node.func) if _name(node.func).split(".")[-1][:1].isupper() else None
        if isinstance(node, ast.Attribute) and _name(node.value) == "self" and self.types:
            return self.fields[self.types[-1]].get(node.attr) or None
        if isinstance(node, ast.Name):
            return self.known.get(node.id) or (node.id if node.id[:1].isupper() else None)
        return None

    def visit_Call(self, node: ast.Call) -> None:
        self.generic_visit(node)
        f = node.func
        dotted = isinstance(f, ast.Attribute)
        name = f.attr if dotted else f.id if isinstance(f, ast.Name) else None
        if name is None:
            return
        args = [_name(a) for a in node.args] + [_name(k.value) for k in node.keywords]
        receiver = _name(f.value) if dotted else None
        kind = "super" if receiver and receiver.startswith("super(") else self._receiver_type(f.value) if dotted else None
        kinds = list(dict.fromkeys(k for k, _ in self.flow))
        self.out["calls"].append({"line": node.lineno - 1, "receiver": receiver, "receiver_type": kind, "name": name, "arguments": args, "type_id": self.owner, "method_id": self.method, "is_constructor": not dotted and name[:1].isupper(), "control_flow": kinds, "guards": list(dict.fromkeys(g for _, g in self.flow if g))[:3]})
        if name in REFLECTIVE_CALLS and args:
            literal = args[-1] if name == "getattr" else args[0]
            self.out["reflections"].append({"owner_id": self.method, "target_kind": REFLECTIVE_CALLS[name], "target": literal.strip("'\"") if literal[:1] in "'\"" else None, "line": node.lineno - 1})


def parse(text: str, module: str, package: bool = False) -> dict:
    """Declarations and calls of one file; package: the file is its package's __init__."""
    r = Reader(module, package)
    tree = ast.parse(text)
    for node in tree.body:
        r.visit(node)
    if any(isinstance(n, ast.If) and "__name__" in _name(n.test) and "__main__" in _name(n.test) for n in tree.body):
        called = {c["name"] for c in r.out["calls"] if c["method_id"] is None}
        for m in r.out["methods"]:
            if m["name"] in called and m["type_id"] == f"module:{module}":
                m["entry_kind"] = m["entry_kind"] or "cli"
    return {"package": module.rpartition(".")[0], "module_id": module, **r.out}
