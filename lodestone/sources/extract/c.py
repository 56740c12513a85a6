"""C: functions, struct, enum and typedef names, variables; calls."""

from __future__ import annotations

import re

from .lex import Calls, Code, Found, FunctionRow, TypeRow, VariableRow, text_hash, without_dot_slash

_TOKENS = re.compile(
    r"(?P<skip>\s+|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|(?:(?<=\n)|\A)[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*|\\\r?\n)"
    r"|(?P<text>(?:L|u8?|U)?\"(?:\\.|[^\"\\\n])*\"?|L?'(?:\\.|[^'\\\n])*'?|\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<name>[^\W\d]\w*)|(?P<mark>->|\.\.\.|&&|\|\||<<=?|>>=?|[=!<>+\-*/%^&|]=|.)",
    re.S,
)
_STATEMENTS = frozenset("if else for while do switch case default return break continue goto sizeof _Alignof alignof typeof __typeof__ offsetof _Generic asm __asm__".split())
_STORAGE = frozenset("static extern inline __inline __inline__ register auto typedef _Thread_local __thread _Noreturn".split())
_QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ _Atomic constexpr".split())
_SIZED = frozenset("unsigned signed long short".split())
_PRIMITIVE = frozenset(
    "bool char int float double void size_t ssize_t ptrdiff_t intptr_t uintptr_t charptr_t nullptr_t max_align_t _Bool "
    "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t char64_t".split()
)
_TAGS = ("struct", "enum", "union")


class _CCalls(Calls):
    keywords = _STATEMENTS | _STORAGE | _QUALIFIERS | _SIZED | frozenset(_TAGS) | (_PRIMITIVE - {"bool"})

    def one(self, i: int, stop: int) -> int:
        code = self.code
        if code.is_(i, "(") and self._is_cast(i):
            return code.close(i) + 1
        if code.is_(i, *_TAGS) and code.is_name(i + 1):
            return i + 2
        if code.is_(i, "__attribute__") and code.is_(i + 1, "("):
            return code.close(i + 1) + 1
        return super().one(i, stop)

    def _is_cast(self, i: int) -> bool:
        """Whether brackets hold a type that only a type can be."""
        code, end = self.code, self.code.close(i)
        names = [code.token[k] for k in range(i + 1, end) if code.is_name(k)]
        if not names or not all(code.is_name(k) or code.is_(k, "*") for k in range(i + 1, end)):
            return False
        if code.is_name(i - 1) and code.token[i - 1] not in self.keywords:
            return False
        known = _QUALIFIERS | _SIZED | _PRIMITIVE | frozenset(_TAGS)
        return names[0] in known or code.is_(end - 1, "*")

    def suffix(self, i: int, stop: int):
        if self.code.is_(i, ".", "->") and self.code.is_name(i + 1):
            return i + 2, None
        return None

    def is_call(self, first: int, i: int) -> bool:
        # behind brackets only a call if they aren't a statement's condition
        return not (self.code.is_(first, "(") and self.code.is_(first - 1, "if", "while", "for", "switch") and self.code.close(first) + 1 == i)


def path_prefix(path: str) -> str:
    path = without_dot_slash(path)
    return path.removesuffix(".c") if path.endswith(".c") else path.removesuffix(".h")


def parse(text: str, path: str) -> Found:
    code, found = Code(text, _TOKENS), Found()
    prefix, i = path_prefix(path), 0
    while i < code.n:
        i = _declaration(code, i, prefix, found)
    return found


def _qualified(prefix: str, name: str) -> str:
    return f"{prefix}.{name}" if prefix else name


def _declaration(code: Code, i: int, prefix: str, found: Found) -> int:
    """Read one declaration or definition; returns where the next begins."""
    if code.is_(i, ";", "}", ")"):
        return i + 1
    if code.is_(i, "extern") and i + 1 < code.n and code.kind[i + 1] == "text":
        return code.close(i + 2) + 1 if code.is_(i + 2, "{") else i + 2
    at, params = i, None
    while at < code.n and not code.is_(at, ";"):
        if code.is_(at, "__attribute__", "__declspec", "_Alignas") and code.is_(at + 1, "("):
            at = code.close(at + 1) + 1
        elif code.is_(at, "("):
            if params is None:
                params = at
            at = code.close(at) + 1
        elif code.is_(at, "{"):
            tagged = code.is_(at - 1, *_TAGS) or code.is_name(at - 1) and code.is_(at - 2, *_TAGS)
            if params is not None and not tagged and not code.is_(at - 1, "=") and code.find(i, at, "=") == at and not code.is_(i, "typedef"):
                end = code.close(at)
                _function(code, i, params, at, end, prefix, found)
                return end + 1
            at = code.close(at) + 1
        else:
            at = code.close(at) + 1 if code.is_(at, "[") else at + 1
    end = min(at, code.n - 1)
    if code.is_(i, "typedef"):
        _typedef(code, i, at, end, prefix, found)
    else:
        _tagged_types(code, i, at, prefix, found)
        _variable(code, i, at, end, prefix, found)
    return at + 1


def _specifiers(code: Code, i: int, stop: int) -> tuple[int, list[tuple[str, int, int]]]:
    """(where declarators begin, [(kind, from, to)]) of a declaration's specifiers."""
    parts: list[tuple[str, int, int]] = []
    typed = False
    while i < stop:
        if code.is_(i, "__attribute__", "__declspec", "_Alignas") and code.is_(i + 1, "("):
            i = code.close(i + 1) + 1
        elif code.is_(i, *_TAGS):
            begin, kind = i, code.token[i]
            i += 1 + code.is_name(i + 1)
            if code.is_(i, "{"):
                i = code.close(i) + 1
            parts.append((kind, begin, i))
            typed = True
        elif code.is_name(i) and code.token[i] in _STORAGE:
            parts.append(("storage", i, i + 1))
            i += 1
        elif code.is_name(i) and code.token[i] in _QUALIFIERS:
            parts.append(("qualifier", i, i + 1))
            i += 1
        elif code.is_name(i) and code.token[i] in _SIZED:
            begin = i
            while code.is_name(i) and code.token[i] in _SIZED | {"int", "char", "double"}:
                i += 1
            parts.append(("sized", begin, i))
            typed = True
        elif code.is_name(i) and not typed and (code.token[i] in _PRIMITIVE or code.is_name(i + 1) or code.is_(i + 1, "*") or code.is_(i + 1, "(") and code.is_(i + 2, "*")):
            parts.append(("primitive" if code.token[i] in _PRIMITIVE else "type", i, i + 1))
            i, typed = i + 1, True
        else:
            break
    return i, parts


def _function(code: Code, i: int, params: int, body: int, end: int, prefix: str, found: Found) -> None:
    declarator, parts = _specifiers(code, i, body)
    at = params
    while code.is_(at, "(") and not code.is_name(at - 1):  # (*name(...))(...)
        inner = code.find(at + 1, code.close(at), "(")
        if inner >= code.close(at):
            return
        at = inner
    if not code.is_name(at - 1) or at - 1 < declarator and not parts:
        return
    name = code.token[at - 1]
    of = " ".join(code.span(a, b) for kind, a, b in parts if kind not in ("storage", "qualifier"))
    stop = max(code.close(params) + 1, code.find(params, body, "{"))
    while stop > declarator and not code.is_(stop - 1, ")"):
        stop -= 1
    signature = f"{of} {code.span(min(declarator, at - 1), stop)}".strip()
    static = any(code.is_(a, "static") for _, a, _ in parts)
    calls = _CCalls(code)
    calls.region(body + 1, end)
    found.functions.append(
        FunctionRow(name, _qualified(prefix, name), text_hash(code.span(i, end + 1)), code.line(i), code.end_line(end), signature, None, "internal" if static else "public", calls.out)
    )


def _tagged_types(code: Code, i: int, stop: int, prefix: str, found: Found) -> None:
    for kind, a, b in _specifiers(code, i, stop)[1]:
        if kind in ("struct", "enum") and code.is_name(a + 1) and code.is_(b - 1, "}"):
            name = code.token[a + 1]
            found.types.append(TypeRow(name, _qualified(prefix, name), kind, code.line(a), code.end_line(b - 1)))


def _typedef(code: Code, i: int, stop: int, end: int, prefix: str, found: Found) -> None:
    """The first plain type name: of two named types that is the one defined from."""
    at, parts = _specifiers(code, i, stop)
    name = next((code.token[a] for kind, a, _ in parts if kind == "type"), None)
    while name is None and at < stop:
        last = code.find(at, stop, ",")
        if code.is_name(at) and at + 1 == last:
            name = code.token[at]
        at = last + 1
    if name:
        found.types.append(TypeRow(name, _qualified(prefix, name), "typedef", code.line(i), code.end_line(end)))


def _declared(code: Code, i: int, stop: int) -> str | None:
    """The name of a plain, pointer or array declarator; none of a function's."""
    while i < stop and (code.is_(i, "*") or code.is_name(i) and code.token[i] in _QUALIFIERS):
        i += 1
    if not code.is_name(i) or code.is_(i + 1, "(") and i + 1 < stop:
        return None
    return code.token[i]


def _variable(code: Code, i: int, stop: int, end: int, prefix: str, found: Found) -> None:
    at, parts = _specifiers(code, i, stop)
    types = [code.span(a, b) for kind, a, b in parts if kind in ("qualifier", "primitive", "type", "struct", "enum")]
    name = None
    while at < stop:
        last = code.find(at, stop, ",")
        value = code.find(at, last, "=")
        shown = _declared(code, at, value)
        if value < last:
            name = shown  # one with a value replaces what stood before
        elif name is None:
            name = shown
        at = last + 1
    storage = {code.token[a] for kind, a, _ in parts if kind == "storage"}
    if name is None or not types or "extern" in storage:
        return
    scope = "static" if "static" in storage else "public"
    found.variables.append(VariableRow(name, _qualified(prefix, name), " ".join(types), code.line(i), code.end_line(end), scope))
