"""Regular expressions: one portable dialect, and the texts that a match must contain."""

from __future__ import annotations

import re
from itertools import product

try:
    import regex as _engine
except ImportError:
    _engine = re

# Constructs that only some engines have: look-around, atomic groups, back-references.
_NOT_PORTABLE = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|\(\?P=")
_ESCAPED_OR_CLASS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$|\(\?P<", re.S)
_CLASS_OPERATOR = re.compile(r"&&|--|~~")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-[a-zA-Z]+)?[:)]")


def _simple_classes(pattern: str) -> bool:
    """Whether no class holds another class or a class operator, which engines read differently."""
    i = 0
    while i < len(pattern):
        found = _ESCAPED_OR_CLASS.match(pattern, i) if pattern[i] in "\\[" else None
        if pattern[i] == "[":
            if found is None:
                return False
            inside = re.sub(r"\\.", "", found.group()[1:-1], flags=re.S)
            if "[" in inside or _CLASS_OPERATOR.search(inside):
                return False
        i = found.end() if found else i + 1
    return True


def pattern_problem(pattern: str) -> str | None:
    """Why a pattern is refused, ``None`` when it is fine."""
    if not _simple_classes(pattern):
        return "nested classes, POSIX classes and class operators are not supported"
    if _NOT_PORTABLE.search(re.sub(r"\\\\", "", pattern)):
        return "look-around and back-references are not supported"
    try:
        _engine.compile(pattern.replace(r"\z", r"\Z"))
    except _engine.error as error:
        return f"invalid pattern: {error}"
    return None


def portable(pattern: str) -> str:
    """The pattern for Spark's ``rlike``: Unicode classes, and ``$`` only at the very end of the text."""
    multi_line = any("m" in m.group(1) for m in _FLAGS.finditer(pattern))

    def fix(m: re.Match) -> str:
        if m.group() == "$":
            return "$" if multi_line else r"\z"
        return "(?<" if m.group() == "(?P<" else m.group()

    return "(?U)" + _ESCAPED_OR_CLASS.sub(fix, pattern)


# Letters that a case-insensitive pattern takes for the same ASCII letter.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u212a\u017f\u0131\u0130"
FOLD_TO = "abcdefghijklmnopqrstuvwxyzksii"
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)

_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d*)(,?)(\d*)\})[?+]?")
_GROUP = re.compile(r"\((?:\?(?:P?<[A-Za-z_]\w*>|[a-zA-Z]*(?:-[a-zA-Z]+)?:))?")
_FLAG_GROUP = re.compile(r"\(\?[a-zA-Z]*(?:-[a-zA-Z]+)?\)")
_LONG_ESCAPE = re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|x(?:\{[^}]*\}|[0-9A-Fa-f]{2})|u[0-9A-Fa-f]{4})")
_SMALL_CLASS = re.compile(r"\[([A-Za-z0-9]{1,4})\]")
# Products of alternatives beyond these sizes are given up for a weaker condition.
MAX_TEXTS, MAX_BRANCHES = 16, 64


class _Opaque(Exception):
    """A construct that is not looked into."""


class _Node:
    """What is known of a piece of a pattern.

    ``texts``: everything it can match, where that is a small set, else ``None``. ``needs``: branches of texts;
    in each match all texts of at least one branch occur. An empty branch says nothing.
    """

    def __init__(self, texts=None, needs=()):
        self.texts = texts
        self.needs = _some_of({""}) if texts is None and not needs else list(needs)

    def branches(self) -> list[frozenset]:
        return self.needs if self.texts is None else _some_of(self.texts)


def _some_of(texts) -> list[frozenset]:
    """Branches for one of several texts; a text inside another makes that one needless."""
    least = [t for t in texts if not any(o != t and o in t for o in texts)]
    return [frozenset()] if "" in least else [frozenset({t}) for t in sorted(least)]


def _shortest(branches: list[frozenset]) -> int:
    return min(max((len(t) for t in b), default=0) for b in branches)


def _both(left: list[frozenset], right: list[frozenset]) -> list[frozenset]:
    if min(len(left), len(right)) > 1 and len(left) * len(right) > MAX_BRANCHES:
        return max(left, right, key=_shortest)
    return list(dict.fromkeys(a | b for a, b in product(left, right)))


def _in_a_row(nodes: list[_Node]) -> _Node:
    needs, run, whole = [frozenset()], {""}, True
    for node in nodes:
        if node.texts is not None and len(run) * len(node.texts) <= MAX_TEXTS:
            run = {a + b for a, b in product(run, node.texts)}
            continue
        whole, needs = False, _both(needs, _some_of(run))
        if node.texts is None:
            needs, run = _both(needs, node.needs), {""}
        else:
            run = node.texts
    return _Node(texts=run) if whole else _Node(needs=_both(needs, _some_of(run)))


def _either(nodes: list[_Node]) -> _Node:
    if all(n.texts is not None for n in nodes):
        texts = set().union(*(n.texts for n in nodes))
        if len(texts) <= MAX_TEXTS:
            return _Node(texts=texts)
    needs = list(dict.fromkeys(b for n in nodes for b in n.branches()))
    return _Node() if frozenset() in needs else _Node(needs=needs)


def _repeated(node: _Node, low: int, high: int | None) -> list[_Node]:
    if low == 0:
        few = high == 1 and node.texts is not None and len(node.texts) < MAX_TEXTS
        return [_Node(texts=node.texts | {""}) if few else _Node()]
    copies = min(low, 3)
    return [node] * copies + ([] if high == copies else [_Node()])


class _Pattern:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        flags = "".join(m.group(1) for m in _FLAGS.finditer(pattern))
        if "x" in flags or "\\Q" in pattern or not _simple_classes(pattern):
            raise _Opaque
        self.any_case = "i" in flags

    def whole(self) -> _Node:
        node = self.alternatives()
        if self.at < len(self.pattern):
            raise _Opaque
        return node

    def alternatives(self) -> _Node:
        nodes = [self.sequence()]
        while self.pattern[self.at : self.at + 1] == "|":
            self.at += 1
            nodes.append(self.sequence())
        return _either(nodes)

    def sequence(self) -> _Node:
        nodes = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            row = [self.piece()]
            while found := _QUANTIFIER.match(self.pattern, self.at):
                self.at = found.end()
                sign, low, comma, high = found.groups()
                node = row[0] if len(row) == 1 else _in_a_row(row)
                if sign:
                    row = _repeated(node, int(sign == "+"), 1 if sign == "?" else None)
                else:
                    least = int(low or 0)
                    row = _repeated(node, least, int(high) if high else None if comma else least)
            nodes += row
        return _in_a_row(nodes)

    def take(self, found: re.Match) -> re.Match:
        self.at = found.end()
        return found

    def piece(self) -> _Node:
        pattern, c = self.pattern, self.pattern[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            if small := _SMALL_CLASS.match(pattern, self.at):
                return _Node(texts={t.translate(_FOLD) for t in self.take(small).group(1)})
            self.take(_ESCAPED_OR_CLASS.match(pattern, self.at))
            return _Node()
        if c == "\\":
            return self.escape()
        if c in "{}*+?":
            raise _Opaque  # engines differ
        self.at += 1
        if c in "^$":
            return _Node(texts={""})
        return _Node() if c == "." else self.character(c)

    def character(self, c: str) -> _Node:
        # outside of ASCII, which characters are the same in any case is left to the engine
        return _Node() if self.any_case and not c.isascii() else _Node(texts={c.translate(_FOLD)})

    def escape(self) -> _Node:
        c = self.pattern[self.at + 1 : self.at + 2]
        if found := _LONG_ESCAPE.match(self.pattern, self.at):
            self.take(found)
            return _Node()
        if c == "" or c in "0123456789cgkNpPuUxEo":
            raise _Opaque
        self.at += 2
        if c in "bBAzZG":
            return _Node(texts={""})
        return _Node() if c.isalnum() else self.character(c)

    def group(self) -> _Node:
        if found := _FLAG_GROUP.match(self.pattern, self.at):
            self.take(found)
            return _Node(texts={""})
        opening = self.take(_GROUP.match(self.pattern, self.at)).group()
        if opening == "(" and self.pattern[self.at : self.at + 1] in ("?", "*"):
            raise _Opaque
        node = self.alternatives()
        if self.pattern[self.at : self.at + 1] != ")":
            raise _Opaque
        self.at += 1
        return node


def required_texts(pattern: str) -> list[list[str]]:
    """Branches of texts: whatever the pattern matches contains, letters folded by ``FOLD_FROM``, all texts of one branch, which
    come longest first.

    An empty list means that nothing is certain: some match needs no text, or the pattern has comments, quoting,
    numeric escapes or classes that engines read differently.
    """
    try:
        branches = _Pattern(pattern).whole().branches()
    except (_Opaque, RecursionError):
        return []
    if frozenset() in branches:
        return []
    return [sorted((t for t in b if not any(t != o and t in o for o in b)), key=lambda t: (-len(t), t)) for b in branches]
