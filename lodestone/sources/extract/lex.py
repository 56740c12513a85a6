"""Tokens, brackets and call chains that the three languages share."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

CLOSERS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Call:
    raw: str
    line: int


@dataclass
class FunctionRow:
    name: str
    qualified_name: str
    ast_hash: str
    line_start: int
    line_end: int
    signature: str
    receiver: str | None
    scope: str
    calls: list[Call]


@dataclass
class TypeRow:
    name: str
    qualified_name: str
    kind: str
    line_start: int
    line_end: int


@dataclass
class VariableRow:
    name: str
    qualified_name: str
    type_name: str
    line_start: int
    line_end: int
    scope: str


@dataclass
class Found:
    functions: list[FunctionRow] = field(default_factory=list)
    types: list[TypeRow] = field(default_factory=list)
    variables: list[VariableRow] = field(default_factory=list)


def text_hash(text: str) -> str:
    """16 hexadecimal digits for the equality of texts."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Code:
    """A text's tokens with their places, lines and matching brackets.

    ``pattern`` has the groups ``skip``, ``name``, ``text`` (strings, characters,
    numbers) and ``mark``.  Brackets without a partner match the end.
    """

    def __init__(self, text: str, pattern: re.Pattern[str]):
        self.text = text
        self.kind: list[str] = []
        self.token: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self._line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
        for m in pattern.finditer(text):
            if m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.token.append(m.group())
                self.start.append(m.start())
                self.end.append(m.end())
        self.n = len(self.token)
        self.match = [self.n] * self.n
        open_: list[int] = []
        for i, t in enumerate(self.token):
            if self.kind[i] != "mark":
                continue
            if t in CLOSERS:
                open_.append(i)
            elif t in ")]}":
                while open_ and CLOSERS[self.token[open_[-1]]] != t and t == "}" and self.token[open_[-1]] != "{":
                    open_.pop()  # an inner bracket was left open
                if open_ and CLOSERS[self.token[open_[-1]]] == t:
                    self.match[open_.pop()] = i

    def line(self, i: int) -> int:
        return bisect.bisect_right(self._line_starts, self.start[min(i, self.n - 1)])

    def end_line(self, i: int) -> int:
        """The line on which token ``i`` ends."""
        return bisect.bisect_right(self._line_starts, max(self.end[min(i, self.n - 1)] - 1, 0))

    def is_(self, i: int, *tokens: str) -> bool:
        return 0 <= i < self.n and self.kind[i] != "text" and self.token[i] in tokens

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "name"

    def span(self, i: int, j: int) -> str:
        """The text from token ``i`` to before token ``j``."""
        return self.text[self.start[i] : self.end[j - 1]] if i < j else ""

    def close(self, i: int) -> int:
        """The place of the partner of bracket ``i``, the last token without one."""
        return min(self.match[i], self.n - 1)

    def find(self, i: int, stop: int, *tokens: str) -> int:
        """The first of ``tokens`` from ``i`` outside brackets, or ``stop``."""
        while i < stop:
            if self.is_(i, *tokens):
                return i
            i = self.close(i) + 1 if self.is_(i, "(", "[", "{") else i + 1
        return stop


class Calls:
    """Call expressions of a region, outer ones before those within them.

    A chain is a primary and what follows it: members, indices, calls.  Of a chain
    with several calls the last is the outermost.  Languages override ``special``
    (what isn't an expression), ``suffix`` (what continues a chain) and
    ``keywords``.
    """

    keywords: frozenset[str] = frozenset()

    def __init__(self, code: Code):
        self.code = code
        self.out: list[Call] = []

    def region(self, i: int, stop: int) -> None:
        while i < stop:
            i = self.one(i, stop)

    def one(self, i: int, stop: int) -> int:
        """Read what begins at ``i``; returns where the next begins."""
        code = self.code
        after = self.special(i, stop)
        if after is not None:
            return max(after, i + 1)
        if code.is_name(i) and code.token[i] not in self.keywords:
            return self.chain(i, i + 1, [], stop)
        if code.is_(i, "("):
            return self.chain(i, code.close(i) + 1, [(i + 1, code.close(i))], stop)
        if code.kind[i] == "text":
            return self.chain(i, i + 1, [], stop)
        return i + 1

    def special(self, i: int, stop: int) -> int | None:
        return None

    def suffix(self, i: int, stop: int) -> tuple[int, tuple[int, int] | None] | None:
        """(end, inner region) of a member or the like at ``i``."""
        return None

    def chain(self, first: int, i: int, inner: list[tuple[int, int]], stop: int) -> int:
        code, found = self.code, []
        while i < stop:
            if code.is_(i, "("):
                if self.is_call(first, i):
                    found.append(i)
                inner.append((i + 1, code.close(i)))
                i = code.close(i) + 1
            elif code.is_(i, "[") and self.is_index(first, i):
                inner.append((i + 1, code.close(i)))
                i = code.close(i) + 1
            elif (more := self.suffix(i, stop)) is not None:
                i = more[0]
                if more[1]:
                    inner.append(more[1])
            else:
                break
        for p in reversed(found):
            self.out.append(Call(code.span(first, p), code.line(first)))
        for a, b in inner:
            self.region(a, min(b, stop))
        return max(i, first + 1)

    def is_call(self, first: int, i: int) -> bool:
        return True

    def is_index(self, first: int, i: int) -> bool:
        return True


def without_dot_slash(path: str) -> str:
    while path.startswith("./"):
        path = path[2:]
    return path


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name
