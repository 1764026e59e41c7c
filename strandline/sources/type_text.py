"""What a type's text in a source stands for."""

from __future__ import annotations

import re

# Wrappers that stand for what is inside them.
WRAPPERS = (
    "Optional", "Awaitable", "Coroutine", "Promise", "PromiseLike", "List", "Array", "ReadonlyArray", "Readonly", "Partial", "Required", "Set", "FrozenSet", "Sequence", "Iterable", "Iterator",
    "Generator", "AsyncIterable", "Collection", "Type", "ClassVar", "Ref", "RefObject", "Signal", "ComputedRef", "Observable", "Future", "Task", "Repository", "Maybe", "Annotated", "Final",
)
# Type texts that name nothing of a project.
BUILTIN_TYPES = (
    "string", "number", "boolean", "any", "unknown", "void", "never", "object", "symbol", "bigint", "null", "undefined",
    "str", "int", "float", "bool", "bytes", "bytearray", "list", "dict", "set", "tuple", "frozenset", "None", "Any", "Optional",
)
EMPTY = {"null", "undefined", "none", "nil"}
BRACKETS = dict(zip("([{<", ")]}>"))


def outside(text: str, separator: str) -> list[str]:
    """The parts between separators that stand in no bracket and no quotes."""
    parts, open_, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in BRACKETS:
            open_ += 1
        elif c in BRACKETS.values():
            open_ -= 1
        elif c == separator and open_ == 0:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]]


def normalize_type_text(text: str | None) -> str:
    """The name of the type that a member is looked up on: no modifiers, empty alternatives, arrays, or transparent wrappers."""
    at = re.sub(r"^(?:->|:)\s*", "", (text or "").strip())
    while at:
        at = re.sub(r"^(?:readonly|typeof|final|val|var)\s+", "", at, flags=re.IGNORECASE)
        at = outside(at, "&")[0].strip()
        at = next((p for p in map(str.strip, outside(at, "|")) if p and p.lower() not in EMPTY), "")
        at = re.sub(r"\[\s*\]$", "", at)
        at = at.removeprefix('"').removeprefix("'").removesuffix('"').removesuffix("'")
        held = re.match(r"([A-Za-z_$][\w$.]*)\s*[<\[](.*)[>\]]\s*$", at, re.DOTALL)
        if not held:
            return re.sub(r"\s+", "", at)
        base = held[1].rpartition(".")[2]
        if base not in WRAPPERS:
            return base
        at = outside(held[2], ",")[0].strip()
    return at


def is_builtin_type_text(text: str | None) -> bool:
    """Whether a type is a primitive or a structure written in place."""
    at = normalize_type_text(text)
    return bool(at) and (at in BUILTIN_TYPES or bool(re.search(r"[{}()=>]", at)))
