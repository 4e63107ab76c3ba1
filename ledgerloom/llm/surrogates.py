"""Personal data: detection in whole texts, and keyed surrogates of the same kind and format.

Entities are e-mail and IP addresses, phone, social security and card numbers, secret tokens, names behind a title and
the other mentions of such a name in the same text. Every distinct entity gets one surrogate throughout the corpus (coreference), and no two entities of a kind get the same one
(distinctness); a surrogate never is an entity of the corpus either. Collisions are found by grouping, and the later
entity draws again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map, materialize

KEY = b"a key for tests; a run that is published takes its own"

# Titles by gender, and given names and family names by script and gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Señorita", "Г-жа", "Госпожа"]
MALE_TITLES = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"]
OPEN_TITLES = ["Dr", "Prof", "Mx"]
#: Small words inside names; they stay as they are.
PARTICLES = ["af", "al", "bin", "da", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "ibn", "la", "le", "ten", "ter", "van", "von", "zu"]
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Ida", "Julia", "Laura", "Marta", "Nora", "Olga", "Rosa", "Sara"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Marco", "Oscar", "Paul"],
    ("latin", "x"): ["Alex", "Chris", "Dana", "Eli", "Jamie", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni", "Val"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Юрий"],
    ("cyrillic", "x"): ["Женя", "Саша", "Валя", "Слава", "Никита", "Шура", "Паша", "Вася"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "da", "del", "fa", "gar", "hol", "ka", "la", "lin", "man", "mo", "na", "ner", "ra", "ron", "sa", "ster", "ta", "val"],
    "cyrillic": ["ба", "бер", "ва", "гор", "да", "ка", "ла", "лин", "ма", "мон", "на", "ра", "рон", "са", "та", "тов"],
}

_TITLE = "|".join(re.escape(t) for t in sorted(FEMALE_TITLES + MALE_TITLES + OPEN_TITLES, key=lambda t: (-len(t), t)))
_EMAIL = re.compile(r"[\w.%+'-]+@[\w-]+(?:\.[\w-]+)+")
#: Openings of keys that are secret wherever they stand, and what follows them.
KEY_SHAPES = [
    ("AKIA", "[0-9A-Z]{16}"), ("ASIA", "[0-9A-Z]{16}"), ("AIza", "[A-Za-z0-9_-]{35}"), ("ya29.", "[A-Za-z0-9_-]{20,}"),
    *((f"gh{c}_", "[A-Za-z0-9]{36,}") for c in "pousr"), ("github_pat_", "[A-Za-z0-9_]{22,}"), ("glpat-", "[A-Za-z0-9_-]{20,}"),
    ("sk-", "[A-Za-z0-9_-]{20,}"), *((f"{k}_{m}_", "[A-Za-z0-9]{16,}") for k in ("sk", "pk", "rk") for m in ("live", "test")),
    *((f"xox{c}-", "[A-Za-z0-9-]{10,}") for c in "abeoprs"), ("hf_", "[A-Za-z0-9]{30,}"), ("npm_", "[A-Za-z0-9]{36}"),
    ("SG.", "[A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}"), ("eyJ", "[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
]
_OPENING = "|".join(re.escape(k) for k, _ in KEY_SHAPES)
_KEY_OPENING = re.compile(_OPENING)
_KEYS = "|".join(f"{re.escape(k)}{rest}" for k, rest in KEY_SHAPES)
_SECRET = re.compile(r"\b(?i:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_=-]{16,})|(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])([0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])|(?<![A-Za-z0-9_-])(" + _KEYS + ")(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}([ -])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{4}(?!\w)")
#: International numbers, grouped or not; national ones with a leading 0; bare ones of ten digits, with or without a 1.
_PHONES = [
    (re.compile(r"(?<![\w+])\+\d{1,4}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,14})){1,7}(?!\w)"), 8, 15),
    (re.compile(r"(?<![\w+.,-])(?:\(0\d{1,5}\)|0\d{1,5})(?:[ ./-]\d{2,8}){1,5}(?![\w-]|[ .,]\d)"), 9, 12),
    (re.compile(r"(?<![\w+.,-])(?:0\d{9,10}|1?[2-9]\d{9})(?![\w-]|[.,]\d)"), 10, 11),
]
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
#: Words that end a name behind a title, unless they stand first; as a name they are not looked for elsewhere.
NO_NAMES = frozenset("a an and as at but by for from had has he her his i if in is it its my no not of on or our she so that the their then there these they this to was we were when who will with you your und der die das er sie et le la il elle y el ella".split())
_UPPER = r"[^\W\d_a-zа-я]"
_WORD = rf"{_UPPER}(?:[^\W\d_]|['’](?!S(?!\w))(?={_UPPER}))+"
_INITIAL = rf"{_UPPER}(?:\.(?=[ -]?{_UPPER})|(?!\w)(?=[ -]{_UPPER}[^\W\d_]))"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)})[ ]+)*"
_NAME_REST = rf"({_SMALL}(?:{_INITIAL}[ -]?)*{_WORD}(?:[ -]{_SMALL}(?:{_INITIAL}[ -]?)*{_WORD})*)"
#: Titles may follow each other; a title in capitals is one only before a name in capitals.
_NAME = re.compile(rf"(?<!\w)((?:(?:{_TITLE})\.?\s+)+)(?!(?:{_TITLE})(?!\w)){_NAME_REST}")
CAPITAL_TITLES = {t.upper(): t for t in FEMALE_TITLES + MALE_TITLES + OPEN_TITLES}
_CAPITALS = "|".join(re.escape(t) for t in sorted(CAPITAL_TITLES, key=lambda t: (-len(t), t)))
_CAPITAL_OPENING = re.compile(rf"(?<!\w)(?:{_CAPITALS})(?:\.\s*|\s+){_UPPER}")
_CAPITAL_NAME = re.compile(rf"(?<!\w)((?:(?:{_CAPITALS})(?:\.\s*|\s+))+)(?!(?:{_CAPITALS})(?!\w))((?:{_UPPER}\.[ ]?)*{_UPPER}(?:{_UPPER}|['’](?={_UPPER}))+(?!\w)(?:[ -]{_UPPER}(?:{_UPPER}|['’](?={_UPPER}))+(?!\w))*)")
_PART = re.compile(rf"{_WORD}|{_UPPER}\.?")


def may_hold(text: Column) -> Column:
    """False only for texts that hold no entity; cheap, so most texts are left alone without Python."""
    # Cn: digits that a later Unicode than the JVM's knows
    marks = text.rlike("[0-9@=:_]") | text.rlike(r"[^\x00-\x7F&&[\p{Nd}\p{Cn}]]")
    for opening in [k for k, _ in KEY_SHAPES if "_" not in k]:
        marks = marks | text.contains(opening)
    for title in [*FEMALE_TITLES, *MALE_TITLES, *OPEN_TITLES, *CAPITAL_TITLES]:
        marks = marks | text.contains(title)
    return F.coalesce(marks, F.lit(False))


def plain_digits(text: str) -> str:
    """The digits of a text, of any script, as 0-9."""
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdecimal())


def script_of(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def gender_of(titles: str) -> str:
    """By the first of a chain of titles that shows one."""
    for title in titles.replace(".", " ").split():
        title = CAPITAL_TITLES.get(title, title)
        if title in FEMALE_TITLES or title in MALE_TITLES:
            return "f" if title in FEMALE_TITLES else "m"
    return "x"


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order, without overlaps (the earlier kind wins).

    A canonical form is what makes two mentions the same entity: case and separators don't count. A name is one entity per
    word, with the script; a given name also carries the gender that the title shows.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    for m in _SECRET.finditer(text):
        found.append((*m.span(m.lastindex), "secret", m[m.lastindex]))
    found += [(m.start(), m.end(), "ip", ".".join(map(plain_digits, m[0].split(".")))) for m in _IP.finditer(text)]
    if ":" in text:
        found += [(*m.span(), "ip6", form) for m in _IP6.finditer(text) if (form := ip6_form(m[0]))]
    found += [(m.start(), m.end(), "ssn", plain_digits(m[0])) for m in _SSN.finditer(text)]
    found += [(m.start(), m.end(), "phone", plain_digits(m[0])) for m in _PHONE.finditer(text)]
    found += [(m.start(), m.end(), "card", plain_digits(m[0])) for m in _CARD.finditer(text)]
    for pattern, least, most in _PHONES:
        found += [(m.start(), m.end(), "phone", form) for m in pattern.finditer(text) if least <= len(form := plain_digits(m[0])) <= most]
    named = list(_NAME.finditer(text))
    if _CAPITAL_OPENING.search(text):
        named += _CAPITAL_NAME.finditer(text)
    for m in named:
        parts = list(_PART.finditer(m[2]))
        stop = next((k for k, p in enumerate(parts) if k and p[0].lower() in NO_NAMES and len(p[0]) > 1), len(parts))
        for k, p in enumerate(parts[:stop]):
            initial = len(p[0].rstrip(".")) == 1
            given = initial or k == 0 and stop > 1
            kind = f"given:{script_of(p[0])}:{gender_of(m[1])}" if given else f"family:{script_of(p[0])}"
            found.append((m.start(2) + p.start(), m.start(2) + p.end(), kind, p[0].lower().rstrip(".").replace("’", "'")))
    out, end = [], -1
    for at in sorted(range(len(found)), key=lambda i: (found[i][0], i)):
        if found[at][0] >= end:
            out.append(found[at])
            end = found[at][1]
    return out


def ip6_form(shown: str) -> str | None:
    """The canonical form of an IPv6 address; None for what is none, or has no digit (``::``, names in code)."""
    try:
        return str(ipaddress.IPv6Address(shown)) if any(c.isdigit() for c in shown) else None
    except ValueError:
        return None


def with_bare_names(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and every other capitalised mention of its name words in the same text, as the same entities.

    A word that is found as a family name counts as that, else as it is found first. Initials and NO_NAMES are left out.
    """
    kinds: dict[str, str] = {}
    for _, _, kind, form in found:
        if kind.startswith(("given", "family")) and len(form) > 1 and form not in NO_NAMES:
            if form not in kinds or kind.startswith("family") and kinds[form].startswith("given"):
                kinds[form] = kind
    if not kinds:
        return found
    words = "|".join(re.escape(w).replace("'", "['’]") for w in sorted(kinds, key=len, reverse=True))
    taken = [(a, b) for a, b, _, _ in found]
    more, k = [], 0
    for m in re.finditer(rf"(?<!\w)(?i:{words})(?!\w)", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        form = m[0].lower().replace("’", "'")
        if m[0][0].isupper() and form in kinds and (k == len(taken) or taken[k][0] >= m.end()):
            more.append((m.start(), m.end(), kinds[form], form))
    return sorted(found + more)


def _stream(key: bytes, kind: str, canonical: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}|{canonical}|{attempt}|{block}".encode(), hashlib.sha256)
        block += 1


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of a surrogate: a keyed draw of the same kind, script, gender and shape."""
    draw = _stream(key, kind, canonical, attempt)
    pick = lambda of: of[(next(draw) << 16 | next(draw) << 8 | next(draw)) % len(of)]
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if kind == "email":
        local, _, host = canonical.rpartition("@")
        shape = "".join(pick(digits) if c.isdigit() else pick(letters) if c.isalpha() else c for c in local)
        shape += "".join(pick(letters) for _ in range(attempt - 3))  # short addresses run out of draws
        return f"{shape}@{'.'.join(''.join(pick(digits) if c.isdigit() else pick(letters) if c.isalnum() else c for c in part) for part in host.split('.')[:-1])}.example"
    if kind == "ip":
        return ".".join(([] if attempt > 2 else ["10"]) + [str(pick(range(256))) for _ in range(4 if attempt > 2 else 3)])
    if kind == "ip6":
        return str(ipaddress.IPv6Address("2001:db8:" + ":".join("".join(pick(digits + "abcdef") for _ in range(4)) for _ in range(6))))
    if kind == "ssn":
        return "".join([pick("1234578"), *(pick(digits) for _ in range(2)), pick("123456789"), pick(digits), pick("123456789"), *(pick(digits) for _ in range(3))])
    if kind == "phone":
        n = len(canonical)  # country and area stay; only where a prefix is used up does the draw reach into it
        if attempt == 0 and n >= 7:
            return canonical[:-7] + "555" + "".join(pick(digits) for _ in range(4))
        head = max(n - 7, min(3, n - 4)) if attempt < 8 else max(n - 10, 1)
        return canonical[:head] + "".join(pick(digits) for _ in range(n - head))
    if kind == "card":
        body = "".join(pick(digits) for _ in canonical[:-1])
        return next(body + d for d in digits if luhn(body + d)) if luhn(canonical) else body + pick(digits)
    if kind == "secret":
        hexadecimal = re.fullmatch("[0-9a-fA-F]+", canonical)
        opening = m[0] if (m := _KEY_OPENING.match(canonical)) else ""
        return opening + "".join(pick(digits) if c.isdigit() else (pick("abcdef" if hexadecimal else letters).upper() if c.isupper() else pick("abcdef" if hexadecimal else letters)) if c.isalpha() else c for c in canonical[len(opening) :])
    parts = kind.split(":")
    base = pick(GIVEN[parts[1], parts[2]]).lower() if parts[0] == "given" else pick(SYLLABLES[parts[1]])
    more = attempt if parts[0] == "given" else 2 + attempt // 4
    return base + "".join(pick(SYLLABLES[parts[1]]) for _ in range(more))


def as_shown(shown: str, kind: str, canonical: str) -> str:
    """A surrogate's canonical form in the format of the mention: separators, and upper or title case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(canonical)
        return "".join(chr(ord(c) - unicodedata.digit(c) + int(next(digits))) if c.isdecimal() else c for c in shown)
    if kind == "ip6":
        return canonical.upper() if shown.isupper() else canonical
    if kind == "email":
        return canonical.upper() if shown.isupper() else canonical
    if kind.startswith(("given", "family")):
        if len(shown.rstrip(".")) == 1:
            return canonical[0].upper() + shown[1:]
        return canonical.upper() if shown.isupper() and len(shown) > 1 else canonical.capitalize()
    return canonical


def mentions(docs: DataFrame) -> DataFrame:
    """(id, start, end, kind, canonical) for every entity of ``docs`` (id, text); start and end count characters."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [(i, *e) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for e in with_bare_names(t, find_entities(t))]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) if out else [[]] * 5, types)], ["id", "start", "end", "kind", "canonical"])

        return batch

    return arrow_map(docs.select("id", "text"), make, "id long, start int, end int, kind string, canonical string", by_row=True)


def assign(entities: DataFrame, key: bytes = KEY, draw=surrogate) -> DataFrame:
    """(kind, canonical, replacement) for distinct (kind, canonical); one replacement for each, none used twice in a kind.

    Rounds: all undecided entities draw; a draw that is an entity or taken is void, of several equal draws the least
    entity's stands. The others draw again with the next attempt.
    """

    def draws(of: DataFrame, attempt: int) -> DataFrame:
        def make():
            def batch(b: pa.RecordBatch) -> pa.RecordBatch:
                kinds, forms = b.column("kind").to_pylist(), b.column("canonical").to_pylist()
                out = [draw(key, k, c, attempt) for k, c in zip(kinds, forms)]
                return pa.RecordBatch.from_arrays([b.column("kind"), b.column("canonical"), pa.array(out, pa.string())], ["kind", "canonical", "replacement"])

            return batch

        return arrow_map(of.select("kind", "canonical"), make, "kind string, canonical string, replacement string")

    known = entities.select("kind", F.col("canonical").alias("replacement"))
    done, left, attempt = None, entities.select("kind", "canonical"), 0
    while True:
        drawn = draws(left, attempt)
        free = drawn.join(known, ["kind", "replacement"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "replacement"), ["kind", "replacement"], "left_anti")
        won = materialize(free.groupBy("kind", "replacement").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "replacement"), "drawn")
        done = won if done is None else done.unionByName(won)
        left = materialize(left.join(won, ["kind", "canonical"], "left_anti"), "undrawn")
        if left.isEmpty():
            return done
        attempt += 1


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with the same columns, entities of the text column replaced; ``count_col`` int is added (or overwritten).

    Detection writes every row once, with its mentions and a number. Rows without mentions are results as they are; of the
    others only mentions, by row number, meet the replacements, and come back to their rows. Texts that cannot hold an
    entity don't pass through Python. A null text stays null with 0 entities. Rows are told apart by their numbers, so
    repeated rows, repeated ids and null ids are handled; equal texts get equal texts. ``id_col`` is not read.
    """
    docs = docs.drop(count_col) if count_col else docs
    columns = docs.columns
    spans_col, row_col = _unused("__spans", columns), _unused("__row", columns)
    mention = "start int, end int, kind string, canonical string"
    none = F.lit(None).cast(f"array<struct<{mention}>>").alias(spans_col)
    may = may_hold(F.col(text_col))
    suspects = docs.filter(may)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())]))

    def detect():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted({tuple(e) for e in with_bare_names(t, find_entities(t))}) for t in b.column(text_col).to_pylist()]
            spans = pa.array([[dict(zip(("start", "end", "kind", "canonical"), e)) for e in f] or None for f in found], kind)
            return pa.RecordBatch.from_arrays([*b.columns, spans], [*columns, spans_col])

        return batch

    told = arrow_map(suspects, detect, suspects.select("*", none).schema, by_row=True).unionByName(docs.filter(~may).select("*", none))
    told = materialize(told.withColumn(row_col, F.monotonically_increasing_id()), "told")
    clean = told.filter(F.col(spans_col).isNull()).select(*columns, *([F.lit(0).alias(count_col)] if count_col else []))
    held = told.filter(F.col(spans_col).isNotNull())
    found = held.select(F.col(row_col).alias("row"), F.explode(spans_col).alias("s")).select("row", "s.*")
    given = materialize(assign(materialize(found.select("kind", "canonical").distinct(), "entities"), key), "surrogates")
    put = F.sort_array(F.collect_list(F.struct("start", "end", "kind", "replacement"))).alias(spans_col)
    spans = materialize(found.join(given, ["kind", "canonical"]).groupBy(F.col("row").alias(row_col)).agg(put), "spans")
    names_out = [*columns, *([count_col] if count_col else [])]

    def replace():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, counts = [], []
            for text, spans_of in zip(b.column(text_col).to_pylist(), b.column(spans_col).to_pylist()):
                parts, end = [], 0
                for s in spans_of:
                    parts += [text[end : s["start"]], as_shown(text[s["start"] : s["end"]], s["kind"], s["replacement"])]
                    end = s["end"]
                texts.append("".join(parts) + text[end:])
                counts.append(len(spans_of))
            arrays = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in columns]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(counts, pa.int32())] * bool(count_col), names_out)

        return batch

    joined = held.drop(spans_col).join(spans, row_col).drop(row_col)
    return clean.unionByName(arrow_map(joined, replace, clean.schema, by_row=True))
