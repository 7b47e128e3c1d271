"""Surrogates for personal data: keyed, of the same type, and consistent over the whole corpus.

Detected: e-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs, social security numbers, telephone numbers, secrets after
names such as token or password, and person names (a listed given name or a title before capitalised words, and all other mentions of
the names so found in the same document, hyphenated ones part by part). Each entity is reduced
to a canonical form and replaced by a form drawn from HMAC-SHA256 of the key, its type, its canonical form and a number of attempts; so the
same entity gets the same surrogate in every document and format (coreference). Surrogates keep the type's checks (Luhn, mod 97),
the length, the class of each character, the mention's punctuation and case; given names keep gender and script, family names the script
and, in Cyrillic, the gender of their ending (both forms of a family's name get the two forms of one surrogate).

The key is an argument and must stay secret: who has it can compute the surrogate of any guess. The query takes it from
spark.tagloom.pii.key, or draws one for the call.

Distinctness is checked over the corpus: a surrogate that is an entity of the corpus, or that another entity has, is drawn again with
the next attempt, until no entity is left (of several that draw the same, the least canonical form keeps it). Given names come from
short lists and are replaced along a keyed cycle through their list, which is one-to-one and never the name itself.

Defined results: null texts stay null, empty texts empty; repeated rows get the same text; extra columns are ignored by the query; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import in_arrow, materialise, slices, table

#: Given names by (gender, script).
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Charlotte Claire Clara Diana Elena Elisabeth Emily Emma Eva Fiona Frances Greta Hannah Helen Ingrid Isabel Jane Julia Karin Laura Linda Lucia Maria Marie Marta Mary Nina Olivia Paula Rosa Sarah Sofia Susan Teresa Ursula".split(),
    ("m", "latin"): "Adam Albert Alexander Andrew Anton Carlos Charles Daniel David Diego Edward Felix Frank Frederick George Hans Henry Hugo James Javier John Jorge Joseph Juan Karl Louis Lukas Manuel Martin Michael Otto Pablo Paul Peter Philip Pierre Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Марина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Βασιλική Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Σπύρος".split(),
}
#: Syllables of which family names are made.
SYLLABLES = {"latin": "ber dal den fen gar hol ker lan mar mon nor per ral ren sal ten tor val ver wen".split(), "cyrillic": "бар вер гор дан зим кол лес мар нов пет рад сан тар хол чер".split(), "greek": "βα γι δο κα λε μα νι πα ρο σα τε φι".split()}
ENDINGS = {"latin": ["son", "er", "mann", "ez", "ley", "ard"], "cyrillic": ["ов", "ин", "ский"], "greek": ["ης", "ος", "ας"]}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

_PLACE = {name: (g, s) for (g, s), names in GIVEN.items() for name in names}
_PART = r"[^\W\d_a-z][^\W\d_]+"
_WORD = rf"{_PART}(?:-{_PART})*"
_NAME = re.compile(rf"(?<![\w-])(?:(?:{'|'.join(TITLES)})\.? +(?:{_WORD} +)?{_WORD}|(?:{_PART}-)*(?:{'|'.join(_PLACE)})(?:-{_PART})* +{_WORD})(?!\w)")
#: Endings of women's family names and those of men's that belong to them.
FEMININE = (("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"))
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_SECRET = re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+]{8,})")
_NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
    r"|(?<![\w.])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?(?:\d{2,4}(?:[ .-]\d{2,4}|[ -]\d{5,8}){1,4}|\d{5,8}(?:[ -]\d{2,8}){1,4})|\+\d{7,15}|\d{10,12})(?!\w|\.\d)"
)
_DATE = re.compile(r"(?:1[89]|20)\d\d([-./ ])\d{1,2}\1\d{1,2}(?!\d)|\d{1,2}([-./ ])\d{1,2}\2(?:1[89]|20)\d\d(?!\d)")
_LOCAL = re.compile(r"\d{3}-\d{4}|\d{2,4}([-.])\d{2,4}\1\d{2,4}")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")


def masculine(name: str) -> str:
    """A family name in the form that a family shares."""
    low = name.casefold()
    return next((name[: -len(f)] + m for f, m in FEMININE if len(low) > len(f) + 1 and low.endswith(f)), name)


def feminine(name: str) -> str:
    return next((name[: -len(m)] + f for f, m in FEMININE if name.endswith(m)), name)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _dialled(whole: str, digits: str) -> bool:
    """Whether groups of digits look like a telephone number: a sign of one before them, ten digits, or a separator that only numbers have."""
    if not 7 <= len(digits) <= 15 or _DATE.match(whole):
        return False
    return whole[0] in "+(0" and len(digits) >= 9 or len(digits) >= 10 or bool(_LOCAL.fullmatch(whole))


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), without overlaps, in order."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text) if any(c.isalnum() for c in m[1])]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            kind, whole = m.lastgroup, m[0]
            digits = re.sub(r"\D", "", whole)
            if kind == "ip":
                if any(int(x) > 255 for x in whole.split(".")):
                    continue
                canonical = ".".join(str(int(x)) for x in whole.split("."))
            elif kind == "iban":
                canonical = whole.replace(" ", "")
                if _mod97(canonical) != 1:
                    continue
            elif kind == "card":
                kind, canonical = ("card", digits) if luhn(digits) else ("number", digits)
                if kind == "number" and _DATE.match(whole):
                    continue
            elif kind == "phone":
                if not _dialled(whole, digits):
                    continue
                canonical = digits[-10:]  # with or without a country code
            else:
                canonical = digits
            found.append((m.start(), m.end(), kind, canonical))
    names: dict[str, tuple[str, str]] = {}
    for m in _NAME.finditer(text):
        for w in re.finditer(r"[^\W\d_]+", m[0]):
            word = w[0]
            if word in TITLES:
                continue
            kind = "given" if word in _PLACE else f"family-{script(word)}"
            found.append((m.start() + w.start(), m.start() + w.end(), kind, word if kind == "given" else masculine(word).casefold()))
            names.setdefault(word, found[-1][2:])
    if names:  # the same names without a title or a given name before them
        found += [(m.start(), m.end(), *names[m[0]]) for m in _LETTERS.finditer(text) if m[0] in names]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class _Draw:
    """A stream of keyed random numbers."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.pool = hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 32:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
            self.left, self.n = 1 << 256, self.n + 1
        self.pool, r = divmod(self.pool, n)
        self.left //= n
        return r


def _alike(text: str, d: _Draw, hexed: bool = False) -> str:
    """Each character by one of its class."""
    out = []
    for c in text:
        if hexed and c in "0123456789abcdef":
            out.append("0123456789abcdef"[d.below(16)])
        elif "0" <= c <= "9":
            out.append(chr(48 + d.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + d.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + d.below(26)))
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form that replaces `canonical` at this attempt."""
    d = _Draw(key, kind, canonical, str(attempt))
    longer = max(0, attempt - 8)  # a form whose namespace is used up grows; a private address becomes any address
    if kind == "given":
        names = GIVEN[_PLACE[canonical]]
        cycle = sorted(names, key=lambda x: hmac.new(key, x.encode(), hashlib.sha256).digest())
        return cycle[(cycle.index(canonical) + 1) % len(cycle)]
    if kind.startswith("family-"):
        s = kind[7:]
        return ("".join(SYLLABLES[s][d.below(len(SYLLABLES[s]))] for _ in range(2 + longer)) + ENDINGS[s][d.below(len(ENDINGS[s]))]).casefold()
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        home = _Draw(key, "domain", domain)
        return _alike(local + "a" * longer, d) + "@" + ".".join([*(_alike(x, home) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        first, second = canonical.split(".")[:2]
        if not longer and (first in ("10", "127") or (first, second) == ("192", "168")):
            head = [first] if first != "192" else [first, second]
        else:
            head = [str([*range(11, 127), *range(128, 169), *range(173, 192), *range(193, 224)][d.below(188 + 19)])]
        return ".".join([*head, *(str(1 + d.below(254)) for _ in range(4 - len(head)))])
    if kind == "card":
        body = canonical[0] + "".join(str(d.below(10)) for _ in canonical[2:])
        return next(body + str(x) for x in range(10) if luhn(body + str(x)))
    if kind == "iban":
        body = canonical[:2] + "00" + _alike(canonical[4:], d)
        return f"{canonical[:2]}{98 - _mod97(body):02d}{body[4:]}"
    if kind == "secret":
        return _alike(canonical + "0" * longer, d, hexed=bool(re.fullmatch(r"[0-9a-f]+", canonical)))
    if kind in ("phone", "ssn", "number"):
        return str(2 + d.below(8)) + "".join(str(d.below(10)) for _ in canonical[1:] + "0" * longer)
    raise ValueError(kind)


def styled(mention: str, kind: str, form: str) -> str:
    """A canonical form in the format of the mention."""
    if kind in ("card", "phone", "ssn", "number"):
        # The country code, over ten digits of a telephone number, stays.
        digits = iter(re.sub(r"\D", "", mention)[: -len(form)] + form)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        chars = iter(form)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "email":
        return "".join(x.upper() if i < len(mention) and mention[i].isupper() else x for i, x in enumerate(form))
    if kind == "given" or kind.startswith("family-"):
        if kind == "family-cyrillic" and masculine(mention) != mention:
            form = feminine(form)
        return form.upper() if mention.isupper() and len(mention) > 1 else form[:1].upper() + form[1:]
    return form


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, int]:
    out, at, found = [], 0, mentions(text)
    for s, e, kind, canonical in found:
        out += [text[at:s], styled(text[s:e], kind, surrogate(kind, canonical, attempts.get((kind, canonical), 0), key))]
        at = e
    return "".join([*out, text[at:]]), len(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entities of each text, which two hashes name."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    for b in slices(batches):
        columns = (b.column(c).to_pylist() for c in ("h1", "h2", "text"))
        rows = [(h1, h2, k, c) for h1, h2, text in zip(*columns, strict=True) if text for k, c in {(k, c) for _, _, k, c in mentions(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["h1", "h2", "kind", "canonical"])


def _drawer(attempt: int, key: bytes):
    def run(batches):
        for b in batches:
            forms = [surrogate(k, c, attempt, key) for k, c in zip(b.column("kind").to_pylist(), b.column("canonical").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canonical"), pa.array(forms, pa.string())], ["kind", "canonical", "form"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, form, attempt for the distinct entities (kind, canonical): no two forms alike, none an entity."""
    entities = materialise(entities.where("kind != 'given'"))
    pending, done, attempt = entities, None, 0
    known = entities.select("kind", F.col("canonical").alias("form"))
    while attempt == 0 or not pending.isEmpty():
        drawn = materialise(pending.transform(in_arrow, _drawer(attempt, key), "kind string, canonical string, form string"))
        free = drawn.join(known, ["kind", "form"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "form"), ["kind", "form"], "left_anti")
        own = materialise(free.groupBy("kind", "form").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "form", F.lit(attempt).alias("attempt")))
        done = own if done is None else done.unionByName(own)
        pending = materialise(pending.join(own, ["kind", "canonical"], "left_anti"))
        attempt += 1
    return done


def _replacer(key: bytes):
    def run(batches):
        for b in slices(batches):
            texts, counts = [], []
            for text, again in zip(b.column("text").to_pylist(), b.column("again").to_pylist(), strict=True):
                out, n = (text, 0) if not text else replace(text, {(x["kind"], x["canonical"]): x["attempt"] for x in again or []}, key)
                texts.append(out)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "n_entities", "text"])

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities and text with surrogates for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    found = materialise(rows.select("h1", "h2", "text").transform(in_arrow, _scan, "h1 long, h2 long, kind string, canonical string"))
    given = assign(found.select("kind", "canonical").distinct(), key)
    later = materialise(given.where("attempt > 0").select("kind", "canonical", "attempt"))
    again = found.join(later, ["kind", "canonical"]).groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("again"))
    rows = rows.join(again, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("doc_id", "text", "again")
    return rows.transform(in_arrow, _replacer(key), "doc_id long, n_entities int, text string")


def session_key(spark) -> bytes:
    """The secret that spark.tagloom.pii.key holds; without one a new key, which nobody has afterwards."""
    held = spark.conf.get("spark.tagloom.pii.key", None)
    return held.encode() if held else secrets.token_bytes(32)


def op3_pii(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), session_key(spark))
