"""HTML tokenizer: regular expressions over runs of characters, one pass, no tree.

Tokens are tuples: ("StartTag", name, [(attribute, value), ...], self_closing), ("EndTag", name), ("Character", data),
("Comment", data), ("DOCTYPE", name, public_id, system_id, correct)."""

from __future__ import annotations

import codecs
import json
import re
from html.entities import html5

STATES = ("data", "rcdata", "rawtext", "script", "plaintext", "cdata")
LONGEST_NAME = 32
_AFTER_TAG = {"title": "rcdata", "textarea": "rcdata", "script": "script", "plaintext": "plaintext"} | dict.fromkeys("style xmp iframe noembed noframes noscript".split(), "rawtext")

_LOWER = {c: c + 32 for c in range(65, 91)}
_REF = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+))(;?)|([A-Za-z0-9]+)(;?))")
_TAG_NAME = re.compile(r"[^\t\n\f />]*")
_GAP = re.compile(r"[\t\n\f /]*")
_SPACE = re.compile(r"[\t\n\f ]*")
_ATTR = re.compile(r"([^\t\n\f />][^\t\n\f />=]*)[\t\n\f ]*(=?)[\t\n\f ]*")
_BARE = re.compile(r"[^\t\n\f >]*")
_SCRIPT_MARK = re.compile(r"<!--|-->|</?script(?=[\t\n\f />])", re.I | re.A)
_COMMENT_END = re.compile(r"--!?>")
_LETTER = re.compile(r"[A-Za-z]")


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


def numeric_char(code: int) -> str:
    if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return "�"
    if 0x80 <= code < 0xA0:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    return chr(code)


def _reference(m: re.Match, in_attribute: bool) -> str:
    hexed, decimal, _, name, end = m.groups()
    if name is None:
        digits = (hexed or decimal).lstrip("0") or "0"
        return numeric_char(0x110000 if len(digits) > 8 else int(digits, 16 if hexed else 10))
    if end and name + ";" in html5:
        return html5[name + ";"]
    for n in range(min(len(name), LONGEST_NAME), 0, -1):
        if name[:n] in html5:
            if in_attribute and (n < len(name) or (not end and m.string[m.end() : m.end() + 1] == "=")):
                return m[0]
            return html5[name[:n]] + name[n:] + end
    return m[0]


def decode_entities(text: str) -> str:
    return _REF.sub(lambda m: _reference(m, False), text) if "&" in text else text


def _decode_attribute(value: str) -> str:
    value = value.replace("\0", "�")
    return _REF.sub(lambda m: _reference(m, True), value) if "&" in value else value


def _clean(s: str) -> str:
    return s.replace("\0", "�")


class _Scan:
    def __init__(self, html: str, state: str, last: str, switch: bool):
        self.s = html.replace("\r\n", "\n").replace("\r", "\n")
        self.state, self.last, self.switch = state, last, switch
        self.out: list[tuple] = []
        self.text: list[str] = []

    def emit(self, *token) -> None:
        if self.text:
            self.out.append(("Character", "".join(self.text)))
            self.text = []
        self.out.append(token)

    def say(self, text: str) -> None:
        if text:
            self.text.append(text)

    def run(self) -> list[tuple]:
        i = 0
        while i < len(self.s):
            i = getattr(self, "in_" + self.state)(i)
        if self.text:
            self.out.append(("Character", "".join(self.text)))
        return self.out

    def in_data(self, i: int) -> int:
        s = self.s
        at = s.find("<", i)
        if at < 0:
            self.say(decode_entities(s[i:]))
            return len(s)
        if at > i:
            self.say(decode_entities(s[i:at]))
        c = s[at + 1 : at + 2]
        if _LETTER.match(c):
            return self.tag(at + 1, True)
        if c == "/":
            c = s[at + 2 : at + 3]
            if _LETTER.match(c):
                return self.tag(at + 2, False)
            if c == ">":
                return at + 3
            if c:
                return self.bogus(at + 2)
            self.say("</")
            return len(s)
        if c == "!":
            return self.declaration(at + 2)
        if c == "?":
            return self.bogus(at + 1)
        self.say("<")
        return at + 1

    def end_of_raw(self, i: int) -> re.Match | None:
        return re.compile(r"</" + re.escape(self.last) + r"(?=[\t\n\f />])", re.I | re.A).search(self.s, i) if self.last else None

    def raw(self, i: int, decode) -> int:
        m = self.end_of_raw(i)
        self.say(decode(_clean(self.s[i : m.start() if m else len(self.s)])))
        return self.tag(m.start() + 2, False) if m else len(self.s)

    def in_rcdata(self, i: int) -> int:
        return self.raw(i, decode_entities)

    def in_rawtext(self, i: int) -> int:
        return self.raw(i, str)

    def in_plaintext(self, i: int) -> int:
        self.say(_clean(self.s[i:]))
        return len(self.s)

    def in_cdata(self, i: int) -> int:
        at = self.s.find("]]>", i)
        self.say(self.s[i : at if at >= 0 else len(self.s)])
        self.state = "data"
        return at + 3 if at >= 0 else len(self.s)

    def in_script(self, i: int) -> int:
        """Text up to the end tag that is neither in a doubly escaped region nor missing."""
        s, at, level = self.s, i, 0  # level 1: after <!--, 2: and after <script
        end = self.end_of_raw(i)
        while True:
            m = _SCRIPT_MARK.search(s, at)
            while end and level < 2 and end.start() < at:
                end = self.end_of_raw(at)
            if end and level < 2 and (not m or end.start() <= m.start()):
                self.say(_clean(s[i : end.start()]))
                return self.tag(end.start() + 2, False)
            if not m:
                self.say(_clean(s[i:]))
                return len(s)
            mark = m[0].lower()
            at = m.end()
            if mark == "<!--":
                if not level:
                    level = 1
                at = m.start() + 2  # its dashes may be those of -->
            elif mark == "-->":
                level = 0
            elif mark == "<script" and level == 1:
                level = 2
            elif mark == "</script" and level == 2:
                level = 1
                if end and end.start() < at:
                    end = self.end_of_raw(at)

    def tag(self, i: int, start: bool) -> int:
        """A tag whose name begins at i; one that the text ends in is dropped."""
        s = self.s
        m = _TAG_NAME.match(s, i)
        name, i = ascii_lower(_clean(m[0])), m.end()
        attrs: list[tuple[str, str]] = []
        names = set()
        while True:
            m = _GAP.match(s, i)
            i = m.end()
            if i >= len(s):
                return i
            if s[i] == ">":
                break
            closing = False
            a = _ATTR.match(s, i)
            i, value = a.end(), ""
            if a[2]:
                c = s[i : i + 1]
                if c in ('"', "'") and c:
                    at = s.find(c, i + 1)
                    if at < 0:
                        return len(s)
                    value, i = s[i + 1 : at], at + 1
                elif c != ">":
                    b = _BARE.match(s, i)
                    value, i = b[0], b.end()
            key = ascii_lower(_clean(a[1]))
            if key not in names:
                names.add(key)
                attrs.append((key, _decode_attribute(value)))
        closing = m.end() > m.start() and s[i - 1] == "/"
        self.state = "data"
        if start:
            self.emit("StartTag", name, attrs, closing)
            self.last = name
            if self.switch:
                self.state = _AFTER_TAG.get(name, "data")
        else:
            self.emit("EndTag", name)
        return i + 1

    def bogus(self, i: int) -> int:
        at = self.s.find(">", i)
        end = at if at >= 0 else len(self.s)
        self.emit("Comment", _clean(self.s[i:end]))
        return end + 1

    def declaration(self, i: int) -> int:
        s = self.s
        if s.startswith("--", i):
            return self.comment(i + 2)
        if ascii_lower(s[i : i + 7]) == "doctype":
            return self.doctype(i + 7)
        return self.bogus(i)

    def comment(self, i: int) -> int:
        s = self.s
        for empty in (">", "->"):
            if s.startswith(empty, i):
                self.emit("Comment", "")
                return i + len(empty)
        m = _COMMENT_END.search(s, i)
        if m:
            self.emit("Comment", _clean(s[i : m.start()]))
            return m.end()
        data = s[i:]
        for pending in ("--!", "--", "-"):
            if data.endswith(pending):
                data = data[: -len(pending)]
                break
        self.emit("Comment", _clean(data))
        return len(s)

    def doctype(self, i: int) -> int:
        s, n = self.s, len(self.s)
        name = public = system = None

        def done(at: int, correct: bool) -> int:
            self.emit("DOCTYPE", name, public, system, correct)
            return at

        def skip(at: int) -> int:
            return _SPACE.match(s, at).end()

        def rest(at: int, correct: bool) -> int:
            end = s.find(">", at)
            return done(n if end < 0 else end + 1, correct)

        def quoted(at: int) -> tuple[str, int, bool]:
            """The identifier, where it ends, and whether its quote is there."""
            ends = [x for x in (s.find(s[at], at + 1), s.find(">", at + 1)) if x >= 0]
            end = min(ends, default=n)
            return _clean(s[at + 1 : end]), end, end < n and s[end] == s[at]

        i = skip(i)
        if i >= n or s[i] == ">":
            return done(i + 1, False)
        m = re.compile(r"[^\t\n\f >]*").match(s, i)
        name, i = ascii_lower(_clean(m[0])), skip(m.end())
        if i >= n:
            return done(n, False)
        if s[i] == ">":
            return done(i + 1, True)
        word = ascii_lower(s[i : i + 6])
        if word not in ("public", "system"):
            return rest(i, False)
        i = skip(i + 6)
        if i >= n or s[i] not in "\"'":
            return rest(i, False)
        value, i, closed = quoted(i)
        if word == "public":
            public = value
        else:
            system = value
        if not closed:
            return done(i + 1, False)
        i = skip(i + 1)
        if word == "public" and i < n and s[i] in "\"'":
            system, i, closed = quoted(i)
            if not closed:
                return done(i + 1, False)
            i, word = skip(i + 1), "system"
        if i >= n:
            return done(n, False)
        if s[i] == ">":
            return done(i + 1, True)
        return rest(i, word == "system")


def tokenize(html: str) -> list[tuple]:
    return _Scan(html, "data", "", True).run()


def tokenize_state(html: str, state: str, last_start_tag: str = "") -> list[tuple]:
    """From a given state, which only end tags change."""
    if state not in STATES:
        raise ValueError(f"unknown tokenizer state {state!r}; one of {', '.join(STATES)}")
    return _Scan(html, state, ascii_lower(last_start_tag), False).run()


def token_json(tokens: list[tuple]) -> str:
    """Tokens as a JSON array of arrays."""
    return json.dumps(tokens, ensure_ascii=False, separators=(",", ":"))


def _replace_each(e: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (e.end - e.start), e.end


codecs.register_error("tagloom-each-byte", _replace_each)


def repair_utf8(raw: bytes) -> str:
    """Bytes as text, each ill-formed byte as one U+FFFD."""
    return raw.decode("utf-8", "tagloom-each-byte")
