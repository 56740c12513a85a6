"""Rust: functions, methods of impl blocks, types, inline modules; calls."""

from __future__ import annotations

import re

from .lex import Calls, Code, Found, FunctionRow, TypeRow, text_hash, without_dot_slash

_TOKENS = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/|\Z))"
    r"|(?P<text>b?r(?P<hashes>#*)\".*?\"(?P=hashes)|[bc]?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|\d[\w]*(?:\.\d[\w]*)?)"
    r"|(?P<name>r#\w+|[^\W\d]\w*|'[^\W\d]\w*)|(?P<mark>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||[=!<>+\-*/%^&|]=|.)",
    re.S,
)
_KEYWORDS = frozenset(
    "as async break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct "
    "super trait type unsafe use where while yield await box".split()
) - {"crate", "super"}


class _RustCalls(Calls):
    keywords = _KEYWORDS

    def special(self, i: int, stop: int) -> int | None:
        code = self.code
        if code.is_(i, "#") and (code.is_(i + 1, "[") or code.is_(i + 1, "!") and code.is_(i + 2, "[")):
            return code.close(i + 1 + code.is_(i + 1, "!")) + 1
        if code.is_(i, "let"):
            return _find(code, i + 1, stop, "=", ";", "else")
        if code.is_(i, "for") and not code.is_(i + 1, "<"):
            at = code.find(i + 1, stop, "in", "{", ";")
            return at if code.is_(at, "in") else i + 1
        if code.is_(i, "match"):
            brace = code.find(i + 1, stop, "{")
            self.region(i + 1, brace)
            if brace < stop:
                self.arms(brace + 1, code.close(brace))
            return self._continue(i, min(code.close(brace) + 1, stop) if brace < stop else stop, stop)
        if code.is_(i, "fn") and code.is_name(i + 1):
            body = code.find(i + 2, stop, "{", ";")
            return body
        if code.is_(i, "impl", "trait", "mod", "struct", "enum", "union") and (code.is_name(i + 1) or code.is_(i + 1, "<")) and not code.is_(i - 1, ":", "->", "&", "<", ",", "(", "mut"):
            body = code.find(i + 1, stop, "{", ";")
            return body if code.is_(i, "impl", "trait", "mod") else (code.close(body) + 1 if body < stop else stop)
        if code.is_(i, "use"):
            return code.find(i + 1, stop, ";")
        if code.is_name(i) and code.token[i] not in _KEYWORDS:
            at = i + 1
            while code.is_(at, "::") and code.is_name(at + 1):
                at += 2
            if code.is_(at, "!") and code.is_(at + 1, "(", "[", "{") and not code.is_(at + 1, "="):
                return self._continue(i, code.close(at + 1) + 1, stop)  # a macro's tokens are its own
        return None

    def _continue(self, first: int, i: int, stop: int) -> int:
        """What follows a macro or block as a member call."""
        return self.chain(first, i, [], stop) if self.code.is_(i, ".", "?") and i < stop else i

    def arms(self, i: int, stop: int) -> None:
        """Arms of a match: patterns hold no calls, guards and results do."""
        code = self.code
        while i < stop:
            arrow = code.find(i, stop, "=>")
            guard = code.find(i, arrow, "if")
            if guard < arrow:
                self.region(guard, arrow)
            if arrow >= stop:
                return
            i = arrow + 1
            end = code.close(i) + 1 if code.is_(i, "{") else code.find(i, stop, ",")
            if code.is_(i, "{") and code.is_(end, ".", "?"):
                end = code.find(end, stop, ",")
            self.region(i, end)
            i = end + code.is_(end, ",")

    def suffix(self, i: int, stop: int):
        code = self.code
        if code.is_(i, "?"):
            return i + 1, None
        if code.is_(i, ".") and (code.is_name(i + 1) or i + 1 < stop and code.kind[i + 1] == "text"):
            return i + 2, None
        if code.is_(i, "::") and code.is_name(i + 1):
            return i + 2, None
        if code.is_(i, "::") and code.is_(i + 1, "<"):
            return _angle_end(code, i + 1, stop), None
        return None

    def is_index(self, first: int, i: int) -> bool:
        return True

    def is_call(self, first: int, i: int) -> bool:
        return not self.code.is_(i - 1, "?")


def _find(code: Code, i: int, stop: int, *tokens: str) -> int:
    """``find`` that leaves out what angle brackets hold."""
    while i < stop and not code.is_(i, *tokens):
        if code.is_(i, "<"):
            i = _angle_end(code, i, stop)
        else:
            i = code.close(i) + 1 if code.is_(i, "(", "[", "{") else i + 1
    return min(i, stop)


def _angle_end(code: Code, i: int, stop: int) -> int:
    """Behind the angle bracket that closes the one at ``i``."""
    depth = 0
    while i < stop:
        if code.is_(i, "<"):
            depth += 1
        elif code.is_(i, ">"):
            depth -= 1
            if not depth:
                return i + 1
        elif code.is_(i, ">="):
            return i + 1
        elif code.is_(i, "(", "[", "{"):
            i = code.close(i)
        elif code.is_(i, ";"):
            return i
        i += 1
    return i


def module_path(path: str) -> str:
    """``src/a/b.rs`` as ``a::b``; the crate's root is empty."""
    path = without_dot_slash(path)
    path = path.removeprefix("src/").removesuffix(".rs")
    if path in ("lib", "main"):
        return ""
    return path.removesuffix("/mod").replace("/", "::")


def parse(text: str, path: str) -> Found:
    code, found = Code(text, _TOKENS), Found()
    _items(code, 0, code.n, module_path(path), found)
    return found


def _joined(*parts: str | None) -> str:
    return "::".join(p for p in parts if p)


def _items(code: Code, i: int, stop: int, module: str, found: Found, owner: str | None = None) -> None:
    """Items of a module, or with ``owner`` the functions of an impl block."""
    while i < stop:
        if code.is_(i, "#"):
            at = i + 1 + code.is_(i + 1, "!")
            i = code.close(at) + 1 if code.is_(at, "[") else i + 1
            continue
        start, public = i, False
        if code.is_(i, "pub"):
            public, i = True, i + 1
            if code.is_(i, "("):
                i = code.close(i) + 1
        while i < stop and (code.is_(i, "async", "unsafe", "default", "extern") or code.is_(i, "const") and code.is_(i + 1, "fn", "unsafe", "async", "extern")):
            i += 1
            if i < stop and code.kind[i] == "text":
                i += 1
        if code.is_(i, "fn") and code.is_name(i + 1):
            i = _function(code, start, i, stop, public, module, owner, found)
        elif owner is None and code.is_(i, "impl"):
            i = _impl(code, i, stop, module, found)
        elif owner is None and code.is_(i, "struct", "enum", "trait") and code.is_name(i + 1):
            kind = "interface" if code.token[i] == "trait" else code.token[i]
            end = _find(code, i + 2, stop, "{", ";")
            end = code.close(end) if code.is_(end, "{") else min(end, stop - 1)
            name = code.token[i + 1]
            found.types.append(TypeRow(name, _joined(module, name), kind, code.line(start), code.end_line(end)))
            i = end + 1
        elif owner is None and code.is_(i, "mod") and code.is_name(i + 1):
            if code.is_(i + 2, "{"):
                _items(code, i + 3, code.close(i + 2), _joined(module, code.token[i + 1]), found)
                i = code.close(i + 2) + 1
            else:
                i += 3
        else:
            end = code.find(i, stop, ";", "{")
            i = code.close(end) + 1 if code.is_(end, "{") else end + 1


def _function(code: Code, start: int, i: int, stop: int, public: bool, module: str, owner: str | None, found: Found) -> int:
    name, at = code.token[i + 1], i + 2
    if code.is_(at, "<"):
        at = _angle_end(code, at, stop)
    if not code.is_(at, "("):
        return i + 1
    params = code.close(at)
    body = code.find(params + 1, stop, "{", ";")
    has_body = code.is_(body, "{")
    end = code.close(body) if has_body else min(body, stop - 1)
    returns = ""
    if code.is_(params + 1, "->"):
        returns = code.span(params + 2, code.find(params + 2, body, "where"))
    if has_body:
        calls = _RustCalls(code)
        calls.region(body + 1, end)
        signature = f"fn {name}{code.span(at, params + 1)}" + (f" -> {returns}" if returns else "")
        found.functions.append(
            FunctionRow(
                name, _joined(module, owner, name), text_hash(code.span(start, end + 1)), code.line(start), code.end_line(end), signature, owner, "public" if public else "internal", calls.out
            )
        )
    return end + 1


def _impl(code: Code, i: int, stop: int, module: str, found: Found) -> int:
    at = i + 1
    if code.is_(at, "<"):
        at = _angle_end(code, at, stop)
    body = _find(code, at, stop, "{", ";")
    if not code.is_(body, "{"):
        return body + 1
    for_ = _find(code, at, body, "for")
    begin = for_ + 1 if for_ < body else at
    owner = code.span(begin, min(_find(code, begin, body, "where"), body)).strip()
    owner = owner.lstrip("&").strip().removeprefix("mut ").strip()
    _items(code, body + 1, code.close(body), module, found, owner or None)
    return code.close(body) + 1
