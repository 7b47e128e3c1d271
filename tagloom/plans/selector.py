"""CSS selectors: grammar, and matching within one tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tagloom.operators.scan import ascii_lower
from tagloom.operators.tree import ELEMENT, TEXT, Tree, split_ws

# Patterns of the grammar. Letters of keywords are matched in either case, in ASCII alone.
_WS = r"[ \t\n\r\f]*"
_NAME = r"[A-Za-z0-9_\-\x80-\U0010FFFF]"
_OP = r"[~|^$*]?="
_FLAGS = ("first-child", "last-child", "only-child", "empty")
_STEP = rf"(?P<word>odd|even)|(?P<a>[+-]?[0-9]{{0,9}})n(?:{_WS}(?P<sign>[+-]){_WS}(?P<b>[0-9]{{1,9}}))?|(?P<only>[+-]?[0-9]{{1,9}})"


def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.I | re.A)


#: What a compound may begin with.
_TAG = _pattern(rf"\*|(?P<tag>{_NAME}+)|")
#: A whole condition other than :not().
_CONDITION = _pattern(
    rf"\#(?P<id>{_NAME}+)|\.(?P<class>{_NAME}+)"
    rf"|\[{_WS}(?P<attr>{_NAME}+){_WS}(?:(?P<op>{_OP}){_WS}(?:(?P<bare>{_NAME}+)|\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'){_WS})?\]"
    rf"|:(?P<flag>{'|'.join(_FLAGS)})(?!{_NAME})"
    rf"|:(?P<nth>nth-child|nth-last-child)\({_WS}(?:{_STEP}){_WS}\)"
)
_NOT = _pattern(rf":not\({_WS}")
#: How far the beginning of a condition is well formed.
_AS_FAR = _pattern(
    rf"[#.]|\[{_WS}(?:{_NAME}+{_WS}(?:{_OP}{_WS}(?:(?:{_NAME}+|\"[^\"]*\"|'[^']*'){_WS})?)?)?"
    rf"|:(?:(?:nth-child|nth-last-child)\({_WS}|{_NAME}+)?"
)
#: What may follow a compound.
_LINK = _pattern(rf"{_WS}(?:(?P<to>[>+~]){_WS}|(?P<comma>,){_WS}|(?P<end>\Z))|[ \t\n\r\f]+")
_SPACE = _pattern(_WS)


class SelectorError(ValueError):
    code = "BAD_SELECTOR"

    def __init__(self, offset: int):
        super().__init__(f"BAD_SELECTOR at character {offset}")
        self.offset = offset


@dataclass(frozen=True)
class Test:
    """One condition: kind id, class, attr, flag, nth, nth-last or not; what it compares is in name, op and value."""

    kind: str
    name: str = ""
    op: str = ""
    value: object = None


@dataclass(frozen=True)
class Compound:
    tag: str | None
    tests: tuple[Test, ...]


#: A complex selector is ((combinator, compound), ...); the first combinator is empty.
Complex = tuple[tuple[str, Compound], ...]


def _condition(m: re.Match) -> Test:
    kind = m.lastgroup if m["nth"] is None and m["attr"] is None else "nth" if m["nth"] else "attr"
    if kind == "attr":
        value = next((x for x in m.group("bare", "double", "single") if x is not None), None)
        return Test("attr", ascii_lower(m["attr"]), m["op"] or "", value)
    if kind == "nth":
        return Test("nth" if ascii_lower(m["nth"]) == "nth-child" else "nth-last", value=_step(m))
    return Test("flag", ascii_lower(m["flag"])) if kind == "flag" else Test(kind, value=m[kind])


def _step(m: re.Match) -> tuple[int, int]:
    if m["word"]:
        return 2, int(ascii_lower(m["word"]) == "odd")
    if m["only"]:
        return 0, int(m["only"])
    sign = m["a"] if m["a"][-1:].isdigit() else m["a"] + "1"
    return int(sign), int((m["sign"] or "") + (m["b"] or "0"))


def parse_selector(text: str) -> list[Complex]:
    """The complex selectors of a list, read from left to right; compounds that a :not() is in wait on a stack."""
    complexes: list[Complex] = []
    steps: list[tuple[str, Compound]] = []
    waiting: list[tuple[int, str | None, list[Test]]] = []
    combinator, at, fresh = "", _SPACE.match(text).end(), True
    while True:
        if fresh:
            m = _TAG.match(text, at)
            waiting.append((at, m["tag"] and ascii_lower(m["tag"]), []))
            at = m.end()
        if fresh := bool(m := _NOT.match(text, at)):
            at = m.end()
            continue
        if m := _CONDITION.match(text, at):
            waiting[-1][2].append(_condition(m))
            at = m.end()
            continue
        if m := _AS_FAR.match(text, at):
            raise SelectorError(m.end())
        start, tag, tests = waiting.pop()
        if at == start:
            raise SelectorError(at)
        done = Compound(tag, tuple(tests))
        if waiting:
            at = _SPACE.match(text, at).end()
            if not text.startswith(")", at):
                raise SelectorError(at)
            at += 1
            waiting[-1][2].append(Test("not", value=done))
            continue
        steps.append((combinator, done))
        if not (m := _LINK.match(text, at)):
            raise SelectorError(at)
        at, fresh, combinator = m.end(), True, m["to"] or " "
        if m["comma"] or m["end"] is not None:
            complexes.append(tuple(steps))
            steps, combinator = [], ""
            if m["end"] is not None:
                return complexes


def nth_matches(a: int, b: int, place: int) -> bool:
    if a == 0:
        return place == b
    return (place - b) % a == 0 and (place - b) // a >= 0


class Selector:
    """A parsed selector; matches(tree, node) and select(tree)."""

    def __init__(self, text: str):
        self.text, self.complexes = text, parse_selector(text)

    def matches(self, t: Tree, n: int) -> bool:
        return t.kind[n] == ELEMENT and self._run(t)(n)

    def select(self, t: Tree, root: int = 0) -> list[int]:
        """Elements below root in document order."""
        test = self._run(t)
        return [n for n in t.elements(root) if test(n)]

    def placed(self, t: Tree) -> tuple[list[int], list[int]]:
        """What select() returns, and the place of each node among its element siblings."""
        siblings = _siblings(t)
        test = self._run(t, siblings)
        return [n for n in t.elements() if test(n)], siblings[0]

    def _run(self, t: Tree, siblings: tuple | None = None):
        place, before, size = siblings or _siblings(t)
        known: dict[tuple[int, int, int], bool] = {}

        def compound(c: Compound, n: int) -> bool:
            return (c.tag is None or t.name[n] == c.tag) and all(simple(x, n) for x in c.tests)

        def simple(x: Test, n: int) -> bool:
            if x.kind == "id":
                return t.attr(n, "id") == x.value
            if x.kind == "class":
                return x.value in split_ws(t.attr(n, "class") or "")
            if x.kind == "attr":
                return _attr_matches(t.attr(n, x.name), x.op, x.value)
            if x.kind == "not":
                return not compound(x.value, n)
            if x.kind == "nth":
                return nth_matches(*x.value, place[n])
            if x.kind == "nth-last":
                return nth_matches(*x.value, size[t.parent[n]] - place[n] + 1)
            if x.name == "empty":
                return all(t.kind[c] not in (ELEMENT, TEXT) for c in t.children(n))
            return (x.name == "last-child" or place[n] == 1) and (x.name == "first-child" or place[n] == size[t.parent[n]])

        def reaches(k: int, i: int, n: int) -> bool:
            """Whether n matches steps 0..i of complex k; each pair is worked out once."""
            key = (k, i, n)
            if key not in known:
                combinator, c = self.complexes[k][i]
                known[key] = compound(c, n) and (i == 0 or related(k, i, n, combinator))
            return known[key]

        seen: dict[tuple, bool] = {}

        def related(k: int, i: int, n: int, combinator: str) -> bool:
            if combinator == ">":
                return t.parent[n] > 0 and reaches(k, i - 1, t.parent[n])
            if combinator == "+":
                return before[n] > 0 and reaches(k, i - 1, before[n])
            # any ancestor or earlier sibling: known of the nearest one, or it matches itself
            step = t.parent if combinator == " " else before
            path, at, found = [], step[n], False
            while at > 0:
                key = (k, i, at, combinator)
                if key in seen:
                    found = seen[key]
                    break
                path.append(at)
                at = step[at]
            for at in reversed(path):
                found = found or reaches(k, i - 1, at)
                seen[k, i, at, combinator] = found
            return found

        return lambda n: any(reaches(k, len(c) - 1, n) for k, c in enumerate(self.complexes))


def _siblings(t: Tree) -> tuple[list[int], list[int], list[int]]:
    """Place among element siblings, the element before (0: none), and element children of each node."""
    count = [0] * len(t.kind)
    place, before, latest = [0] * len(t.kind), [0] * len(t.kind), [0] * len(t.kind)
    for n in t.elements():
        p = t.parent[n]
        count[p] += 1
        place[n], before[n], latest[p] = count[p], latest[p], n
    return place, before, count


def _attr_matches(have: str | None, op: str, want) -> bool:
    if have is None:
        return False
    if op == "":
        return True
    if op == "=":
        return have == want
    if op == "~=":
        return want in split_ws(have)
    if op == "|=":
        return have == want or have.startswith(want + "-")
    if not want:
        return False
    return {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](want)
