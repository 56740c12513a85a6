"""Go: top-level functions, methods and types; calls within bodies."""

from __future__ import annotations

import re

from .lex import Calls, Code, Found, FunctionRow, TypeRow, stem, text_hash, without_dot_slash

_TOKENS = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<text>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d*)?(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<name>[^\W\d]\w*)|(?P<mark>:=|\.\.\.|<-|&\^|&&|\|\||[=!<>]=|.)",
    re.S,
)
_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for go goto if import interface map package range return select struct switch type var".split()
)


class _GoCalls(Calls):
    keywords = _KEYWORDS

    def special(self, i: int, stop: int) -> int | None:
        code = self.code
        if code.is_(i, "func") and code.is_(i + 1, "("):
            begin = _body_start(code, code.close(i + 1) + 1, stop)
            if begin >= stop:
                return i + 1  # a type
            end = code.close(begin)
            return self.chain(i, end + 1, [(begin + 1, end)], stop)
        if code.is_(i, "[") and not (i and (code.is_name(i - 1) or code.is_(i - 1, ")", "]"))):
            # a slice or array type: a conversion or a literal, not a call
            at = _type_end(code, code.close(i) + 1, stop)
            self.region(i + 1, code.close(i))
            return self._inner(at, stop)
        if code.is_(i, "map") and code.is_(i + 1, "["):
            return self._inner(_type_end(code, i, stop), stop)
        if code.is_(i, "chan"):
            return _type_end(code, i, stop)
        if code.is_(i, "struct", "interface") and code.is_(i + 1, "{"):
            return self._inner(code.close(i + 1) + 1, stop)
        return None

    def _inner(self, i: int, stop: int) -> int:
        """The contents of the brackets behind a type."""
        if i < stop and self.code.is_(i, "(", "{"):
            self.region(i + 1, min(self.code.close(i), stop))
            return self.code.close(i) + 1
        return i

    def suffix(self, i: int, stop: int):
        code = self.code
        if code.is_(i, ".") and code.is_name(i + 1):
            return i + 2, None
        if code.is_(i, ".") and code.is_(i + 1, "("):
            return code.close(i + 1) + 1, None  # a type assertion
        if code.is_(i, "{") and code.is_name(i - 1) and code.is_(code.close(i) + 1, ".") and code.close(i) + 1 < stop:
            return code.close(i) + 1, (i + 1, code.close(i))
        return None


def _type_end(code: Code, i: int, stop: int) -> int:
    """Where the type that begins at ``i`` ends."""
    while i < stop:
        if code.is_(i, "*", "<-"):
            i += 1
        elif code.is_(i, "["):
            i = code.close(i) + 1
        elif code.is_(i, "map") and code.is_(i + 1, "["):
            i = code.close(i + 1) + 1
        elif code.is_(i, "chan"):
            i += 1
        elif code.is_(i, "struct", "interface") and code.is_(i + 1, "{"):
            return code.close(i + 1) + 1
        elif code.is_(i, "func") and code.is_(i + 1, "("):
            return code.close(i + 1) + 1
        elif code.is_name(i):
            i += 1
            while code.is_(i, ".") and code.is_name(i + 1):
                i += 2
            return code.close(i) + 1 if code.is_(i, "[") else i
        else:
            return i
    return i


def _body_start(code: Code, i: int, stop: int) -> int:
    """The brace that opens a function's body behind its parameters."""
    while i < stop:
        if code.is_(i, "struct", "interface") and code.is_(i + 1, "{"):
            i = code.close(i + 1) + 1
        elif code.is_(i, "{"):
            return i
        elif code.is_(i, "(", "["):
            i = code.close(i) + 1
        elif code.is_(i, ",", ";", ")", "}", "=", ":="):
            return stop
        elif i and code.line(i) != code.end_line(i - 1):
            return stop  # a line end ends a declaration without a body
        else:
            i += 1
    return stop


def path_prefix(path: str) -> str:
    """The directory; of a file in the root its stem."""
    path = without_dot_slash(path)
    return path.rsplit("/", 1)[0] if "/" in path else stem(path)


def parse(text: str, path: str) -> Found:
    code, found = Code(text, _TOKENS), Found()
    base, i = path_prefix(path), 0
    while i < code.n:
        if code.is_(i, "package") and code.is_name(i + 1):
            base = base or code.token[i + 1]
            i += 2
        elif code.is_(i, "func"):
            i = _function(code, i, base, path, found)
        elif code.is_(i, "type"):
            i = _types(code, i, base, found)
        else:
            i = code.close(i) + 1 if code.is_(i, "(", "[", "{") else i + 1
    return found


def _receiver(code: Code, i: int, end: int) -> str | None:
    """The first parameter's type without pointers, as it is written."""
    stop = code.find(i, end, ",")
    if i >= stop:
        return None
    if code.is_name(i) and i + 1 < stop and not code.is_(i + 1, ".", "["):
        i += 1
    while i < stop and code.is_(i, "*", "("):
        i, stop = i + 1, stop - (code.token[i] == "(")
    return code.span(i, stop) or None


def _function(code: Code, i: int, base: str, path: str, found: Found) -> int:
    at, receiver, method = i + 1, None, False
    if code.is_(at, "("):
        method, receiver = True, _receiver(code, at + 1, code.close(at))
        at = code.close(at) + 1
    if not code.is_name(at) or method and receiver is None:
        return i + 1
    name, at = code.token[at], at + 1
    if code.is_(at, "["):
        at = code.close(at) + 1
    if not code.is_(at, "("):
        return at
    params_end = code.close(at)
    body = _body_start(code, params_end + 1, code.n)
    if body < code.n:
        end, result = code.close(body), code.span(params_end + 1, body).strip()
    else:
        end = params_end
        while end + 1 < code.n and code.line(end + 1) == code.end_line(end):
            end = code.close(end + 1) if code.is_(end + 1, "(", "[", "{") else end + 1
        result = code.span(params_end + 1, end + 1).strip()
    if receiver is not None:
        qualified = ".".join(x for x in (base, receiver, name) if x)
    else:
        shown = f"init@{stem(path)}" if name == "init" else name
        qualified = f"{base}.{shown}" if base else shown
    calls = _GoCalls(code)
    if body < code.n:
        calls.region(body + 1, end)
    signature = f"func {name}{code.span(at, params_end + 1)}" + (f" {result}" if result else "")
    scope = "public" if name[:1].isupper() else "internal"
    found.functions.append(FunctionRow(name, qualified, text_hash(code.span(i, end + 1)), code.line(i), code.end_line(end), signature, receiver, scope, calls.out))
    return end + 1


def _types(code: Code, i: int, base: str, found: Found) -> int:
    if code.is_(i + 1, "("):
        end = code.close(i + 1)
        at = i + 2
        while at < end:
            at = _type(code, at, end, base, found)
        return end + 1
    return _type(code, i + 1, code.n, base, found)


def _type(code: Code, i: int, stop: int, base: str, found: Found) -> int:
    if not code.is_name(i):
        return i + 1
    name, at = code.token[i], i + 1
    if code.is_(at, "[") and (code.is_name(at + 1) and not code.is_(at + 2, "]")):
        at = code.close(at) + 1  # type parameters
    alias = code.is_(at, "=")
    at += alias
    kind = "struct" if code.is_(at, "struct") else "interface" if code.is_(at, "interface") else "typedef"
    end = max(_type_end(code, at, stop), at + 1)
    if code.is_(at, "func"):  # with its results
        while end < stop and code.line(end) == code.end_line(end - 1) and not code.is_(end, ";"):
            end = code.close(end) + 1 if code.is_(end, "(", "[", "{") else end + 1
    if not alias:
        found.types.append(TypeRow(name, f"{base}.{name}" if base else name, kind, code.line(i), code.end_line(end - 1)))
    return end
