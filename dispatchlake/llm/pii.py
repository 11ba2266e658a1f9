"""Personal data: every detected entity gets a keyed surrogate of its own type and format.

An entity is made of parts: an address of a mailbox and a domain, a name of given and family names, a number of itself.
A part's surrogate is derived from a secret key and the part's canonical form, so all mentions, in whatever spelling,
company and document, get the same one. Before texts are rewritten, the distinct parts of the whole corpus are checked:
no two share a surrogate and no surrogate is a part that occurs. Losers of a clash are derived again with the next
attempt number, which also widens what can be drawn; only these exceptions travel with the rewriting pass.

Names are found behind a title, or where a capitalised word follows a common given name; this is a rule, not a model.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEY = b"surrogates"  # default secret; give your own
EXCEPTIONS = 200_000  # clashes that are sent to every task at most; beyond it they are joined
SLICE = 1 << 20  # bytes of text that are rewritten at once
ATTEMPTS = 64  # derivations of one surrogate before the job fails: its type has no room left
#: Titles by gender; fixed values.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Г-н", "Господин", "Κύριος", "Κος", "श्री"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Госпожа", "Κυρία", "Κα", "श्रीमती"],
    "x": ["Dr", "Prof", "Δρ"],
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: Given names by script and gender, drawn for surrogates and known as names; fixed values.
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Conrad", "Dorian", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Konrad", "Leo", "Martin", "Nico", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Bella", "Clara", "Dora", "Elsa", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Lena", "Mara", "Nora", "Olga", "Paula"],
    ("latin", "x"): ["Alex", "Bo", "Chris", "Dana", "Eli", "Finn", "Gale", "Harper", "Jo", "Kim", "Lee", "Max", "Noa", "Quinn", "Robin", "Sam"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Лев"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара", "Лидия"],
    ("cyrillic", "x"): ["Саша", "Женя", "Валя", "Слава"],
    ("greek", "m"): ["Άρης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος", "Φώτης"],
    ("greek", "f"): ["Άννα", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
#: Further common given names that mark a name without a title; fixed values.
COMMON = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Andrew", "George", "Hans", "Jürgen", "Klaus", "Wolfgang", "Pierre", "Jean", "Louis", "José", "Juan", "Carlos", "Luis", "Miguel", "Antonio"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Laura", "Maria", "Ursula", "Monika", "Sabine", "Marie", "Sophie", "Camille", "Carmen", "Isabel", "Lucía", "Ana", "Elena", "Rosa"],
}
_KNOWN = {n.casefold(): g for (_, g), names in GIVEN.items() for n in names} | {n.casefold(): g for g, names in COMMON.items() for n in names}
#: Consonants and vowels of made-up names by script, and endings by gender; other scripts draw from the name's own block.
LETTERS = {"latin": ("bdfgklmnprstv", "aeio"), "cyrillic": ("бвгдклмнпрст", "аеио"), "greek": ("βγδθκλμνπρστφ", "αεηιο"), "devanagari": ("कगचजतदनपबमरलवस", "ाीेो"), "georgian": ("ბგდვზთკლმნრს", "აეიო"), "armenian": ("բգդզթլկմնպռս", "աեիո")}
ENDINGS = {"latin": {"m": ["us", "an", "or"], "f": ["a", "ina", "elle"], "x": ["en", "is"]}, "cyrillic": {"m": ["ан", "ор"], "f": ["а", "ина"], "x": ["ен"]}, "greek": {"m": ["ος", "ης"], "f": ["α", "η"], "x": ["ις"]}}
#: Country codes of two digits; 1 and 7 have one, all others three. Fixed values.
COUNTRY_CODES = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}

_L = r"(?:[^\W\d_]|[\u0300-\u036F\u0900-\u0DFF])"  # a letter, with the marks of scripts that need them
_WORD = rf"{_L}+(?:['’\-]{_L}+)*"
_TITLE = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE})\.? {_WORD}(?: {_WORD})?")
_PAIR = re.compile(rf"(?<![^\W\d_])[A-ZÀ-ÞΆ-ΫА-Я]{_L}+ (?=[A-ZÀ-ÞΆ-ΫА-Я])({_WORD})")
_CUE = re.compile(r"(?i)(?:phone|tel|call|mobile|cell|fax|tél|тел|telefon)\w{0,6}\W{0,3}$")
_GROUPED = re.compile(r"\d{1,3}(?:[ .]\d{3})+")
_PATTERNS: list[tuple[str, re.Pattern, str]] = [  # (type, pattern, characters of which a text must have one), in order of precedence
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}"), "@"),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), "0123456789"),
    ("secret", re.compile(r"\b((?=[0-9A-Fa-f]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}))\b"), "0123456789"),
    ("secret", re.compile(r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,128}|xox[abpr]-[A-Za-z0-9\-]{10,128})\b"), "-_A"),
    ("secret", re.compile(r"(?i)\b(?:api|secret|access|auth)?[_\- ]?(?:key|secret|token|passw(?:or)?d)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?((?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9+/_\-]{12,128})(?![A-Za-z0-9+/_\-])"), ":="),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"), "."),
    ("ssn", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"), "-"),
    ("card", re.compile(r"(?<![\d\-])(?:\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?![\d\-])"), "0123456789"),
    ("phone", re.compile(r"(?<![\w+])(?<!\d[ .\-])(?:\+\d{1,3}[ .\-]?|1[ .\-])?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?![\w])(?![ .\-]\d)"), "0123456789"),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?![\w])"), "+"),
]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, type, canonical form) of a text, in order, without overlaps.

    Card numbers must have a right check digit and IBANs a right checksum; digits in groups of three are an amount
    unless a word for a telephone stands before them.
    """
    found: list[tuple[int, int, str, str]] = []

    def take(a: int, b: int, kind: str, value: str) -> None:
        if all(b <= x[0] or a >= x[1] for x in found):
            found.append((a, b, kind, value))

    digits = any(c in text for c in "0123456789")
    for kind, pattern, signs in _PATTERNS:
        if kind != "email" and not digits or not any(c in text for c in signs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "secret" else m.span()
            if kind == "iban":
                while b > a + 4 and not _iban_fits(text[a:b]):
                    b = max(text.rfind(" ", a, b), a)
            if kind == "iban" and b <= a + 4 or kind == "card" and not _luhn_fits(text[a:b]):
                continue
            if kind == "phone" and _GROUPED.fullmatch(text, a, b) and not _CUE.search(text, max(0, a - 24), a):
                continue
            take(a, b, kind, canonical(kind, text[a:b]))
    for m in _TITLED.finditer(text):
        title, *words = m.group().split(" ")
        while words and not (words[-1][0].isupper() or words[-1][0].lower() == words[-1][0].upper()):
            words.pop()
        if words:
            take(m.start(), m.start() + len(" ".join([title, *words])), "name", _name(_GENDER[title.rstrip(".")], words))
    for m in _PAIR.finditer(text):
        words = m.group().split(" ")
        if words[0].casefold() in _KNOWN:
            take(*m.span(), "name", _name("x", words))
    return sorted(found)


def _name(gender: str, words: list[str]) -> str:
    """Canonical form: gender of the given name (by the name itself if it is a known one), given name, family name."""
    given = words[0].casefold() if len(words) > 1 else ""
    return "\x1f".join([_KNOWN.get(given, gender), given, words[-1].casefold()])


def canonical(kind: str, value: str) -> str:
    """One form for all spellings of an entity: no case in addresses, no separators in numbers, no country code 1."""
    if kind == "email" or kind == "secret" and re.fullmatch("[0-9A-Fa-f]+", value):
        return value.lower()
    if kind in ("secret", "ip"):
        return value
    number = re.sub(r"[^0-9A-Z]", "", value)
    if kind == "phone":
        if len(number) == 11 and number[0] == "1":
            return number[1:]
        return "+" * value.startswith("+") + number
    return number


def parts(kind: str, value: str) -> list[tuple[str, str]]:
    """(type, value) of the parts of an entity in canonical form. Equal parts of different entities are one part."""
    if kind == "email":
        local, domain = value.split("@")
        return [("mailbox", local), ("domain", domain)]
    if kind == "name":
        gender, given, family = value.split("\x1f")
        return [(f"given-{gender}", given), ("family", family)] if given else [("family", family)]
    return [(kind, value)]


@lru_cache(1 << 12)
def _script(c: str) -> str:
    return unicodedata.name(c, "LATIN").split(" ")[0].split("-")[0].lower()


@lru_cache(1 << 8)
def _block(start: int) -> list[str]:
    """Letters without capitals of a block of 128 characters."""
    return [c for c in map(chr, range(start, start + 128)) if unicodedata.category(c) in ("Ll", "Lo")]


class Surrogates:
    """Keyed replacements of parts, and their fitting to the mention at hand."""

    def __init__(self, key: bytes):
        self.key = key

    def _stream(self, *what: object) -> Iterator[int]:
        block, n = b"", 0
        while True:
            block = hmac.new(self.key, b"\x1f".join(str(x).encode() for x in (*what, n)), hashlib.sha256).digest()
            n += 1
            yield from block

    def make(self, kind: str, value: str, attempt: int = 0) -> str:
        """Surrogate of a part; attempt > 0 after clashes."""
        s = self._stream(kind, value, attempt)

        def pick(n: int) -> int:
            return (next(s) << 24 | next(s) << 16 | next(s) << 8 | next(s)) % n

        digit = lambda: str(pick(10))
        like = lambda c: digit() if c.isdigit() else chr(97 + pick(26)) if c.islower() else chr(65 + pick(26)) if c.isupper() else c
        if kind == "mailbox":
            return "".join(map(like, value)) + "".join(chr(97 + pick(26)) for _ in range(attempt - 1))
        if kind == "domain":
            return "mail" + "".join("0123456789abcdefghijklmnopqrstuvwxyz"[pick(36)] for _ in range(6 + attempt)) + ".example.org"
        if kind == "secret":
            if re.fullmatch("[0-9a-f]+", value):
                return "".join("0123456789abcdef"[pick(16)] for _ in value)
            lead = re.match(r"AKIA|[A-Za-z]{2,4}[_\-]|", value).end()  # the issuer's mark stays
            return value[:lead] + "".join(map(like, value[lead:]))
        if kind == "ip":
            return ".".join(str(1 + pick(n)) for n in (222, 254, 254, 254))
        if kind == "ssn":
            area = f"9{pick(100):02d}" if attempt < 8 else f"{1 + pick(999):03d}"  # areas from 900 are never given out
            return f"{area}{1 + pick(99):02d}{1 + pick(9999):04d}"
        if kind == "card":
            body = value[0] + "".join(digit() for _ in value[1:-1])
            return body + _luhn_digit(body)
        if kind == "iban":
            body = "".join(map(like, value[4:]))
            number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
            return f"{value[:2]}{98 - number % 97:02d}{body}"
        if kind == "phone":
            lead = 0
            if value.startswith("+"):
                lead = 2 if value[1] in "17" else 3 if value[1:3].isdigit() and int(value[1:3]) in COUNTRY_CODES else 4
            return value[:lead] + "".join(digit() for _ in value[lead:])
        gender = kind.partition("-")[2]  # none for a family name
        script = _script(value[0])
        if gender and not attempt and (script, gender) in GIVEN:
            return GIVEN[script, gender][pick(len(GIVEN[script, gender]))].casefold()
        if script not in LETTERS:
            letters = _block(ord(value[0]) & ~127) or list(value)
            return "".join(letters[pick(len(letters))] for _ in range(max(2, len(value)) + attempt // 2))
        hard, soft = LETTERS[script]
        name = "".join(hard[pick(len(hard))] + soft[pick(len(soft))] for _ in range((2 if gender else 4) + attempt // 2))
        endings = ENDINGS.get(script, {}).get(gender)
        return name[:-1] + endings[pick(len(endings))] if endings else name

    @staticmethod
    def fit(kind: str, mention: str, made: list[str]) -> str:
        """The parts' surrogates in the mention's format: same separators, case, title and country code."""
        if kind == "email":
            out = "@".join(made)
            return out.upper() if mention.isupper() else out
        if kind == "secret":
            return made[0].upper() if re.fullmatch("[0-9A-F]+", mention) else made[0]
        if kind == "ip":
            return made[0]
        if kind == "name":
            words = mention.split(" ")
            old = words[-len(made) :]
            case = lambda n, o: n.upper() if len(o) > 1 and o.isupper() else n.title() if o[0].isupper() else n
            return " ".join([*words[: -len(made)], *map(case, made, old)])
        new = made[0].removeprefix("+")
        kept = sum(c.isalnum() for c in mention) - len(new)  # a country code that isn't part of the canonical form
        chars = iter([c for c in mention if c.isalnum()][:kept] + list(new))
        return "".join(next(chars) if c.isalnum() else c for c in mention)


def _luhn_fits(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return 13 <= len(digits) <= 19 and digits[-1] == _luhn_digit(digits[:-1])


def _iban_fits(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


_PART = "kind string, value string"
_MADE = f"{_PART}, attempt int, surrogate string"


def _slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some SLICE bytes of text (or one longer text), so that few texts are Python strings at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        seen = {x for t in batch.column(0).to_pylist() if t for _, _, kind, value in detect(t) for x in parts(kind, value)}
        yield C.record_batch({"kind": [k for k, _ in seen], "value": [v for _, v in seen]}, _PART)


def _made(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for batch in batches:
            rows = batch.to_pydict()
            out = [s.make(*x) for x in zip(rows["kind"], rows["value"], rows["attempt"], strict=True)]
            yield C.record_batch(rows | {"surrogate": out}, _MADE)

    return run


def part_table(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kind, value, attempt, surrogate) of each distinct part of the corpus, without clashes; and those of attempt > 0.

    A clash is a surrogate that two parts of a type share (the smallest keeps it), that an earlier attempt made, or that
    is itself a part of its type. Only losers go on to the next attempt. If some are left after ATTEMPTS, their type has
    no room for them and the job fails.
    """
    C.prepare(docs.sparkSession)
    todo = C.store(docs.select(F.col(text_col).alias("text")).mapInArrow(_found, _PART).distinct(), "parts")
    real = todo.select("kind", F.col("value").alias("surrogate"))
    rounds, settled = [], []
    for attempt in range(ATTEMPTS):
        made = C.store(todo.withColumn("attempt", F.lit(attempt)).mapInArrow(_made(key), _MADE), "surrogates")
        same = made.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("keeps")).filter("n > 1")
        lost = made.join(same.drop("n"), ["kind", "surrogate"]).filter("value <> keeps").select("kind", "value")
        for used in (real, *(x.select("kind", "surrogate") for x in rounds)):
            lost = lost.union(made.join(used, ["kind", "surrogate"], "left_semi").select("kind", "value"))
        lost = C.store(lost.distinct(), "clashes")
        rounds.append(made)
        settled.append(made.join(lost, ["kind", "value"], "left_anti"))
        if lost.isEmpty():
            break
        todo = lost
    else:
        raise RuntimeError(f"no free surrogates are left after {ATTEMPTS} attempts for parts such as {lost.first()}")
    whole, more = settled[0], made.filter("attempt > 0")
    for x in settled[1:]:
        whole = whole.unionByName(x)
    for x in settled[1:-1]:
        more = more.unionByName(x)
    return whole, more


def surrogate_table(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate) of each distinct entity of the corpus, put together from its parts."""
    whole, _ = part_table(docs, key, text_col)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {x[2:] for t in batch.column(0).to_pylist() if t for x in detect(t)}
            rows = [(k, v, n, *p) for k, v in seen for n, p in enumerate(parts(k, v))]
            yield C.record_batch(dict(zip(("entity", "canonical", "n", "kind", "value"), map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(("entity", "canonical", "n", "kind", "value"), []), f"entity string, canonical string, n int, {_PART}")

    mentions = docs.select(F.col(text_col).alias("text")).mapInArrow(split, f"entity string, canonical string, n int, {_PART}").distinct()
    named = mentions.join(whole, ["kind", "value"]).groupBy("entity", "canonical").agg(F.sort_array(F.collect_list(F.struct("n", "surrogate"))).alias("p"))
    return named.select(F.col("entity").alias("kind"), F.col("canonical").alias("value"), F.expr("array_join(p.surrogate, if(entity = 'email', '@', ' '))").alias("surrogate"))


def replace_entities(docs: DataFrame, key: bytes = KEY, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in ``text_col`` and the number of replaced mentions in ``count_col`` (None: not wanted).

    Null texts stay null, texts without entities stay as they are, and texts of any length are read whole. Repeated rows
    get the same replacements; an empty table gives no rows. A column named ``count_col`` is replaced, all others pass
    through. Overlapping finds go to the type that comes first in _PATTERNS.
    """
    _, more = part_table(docs, key, text_col)
    more = C.store(more.select("kind", "value", "attempt"), "exceptions")
    drop = {x.lower() for x in (text_col, count_col) if x}
    keep = [c for c in docs.columns if c.lower() not in drop]
    body_col, own_col = C.fresh("body", docs.columns), C.fresh("own", docs.columns)
    body = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(body_col))
    if C.fits(more, EXCEPTIONS):
        known = {(r["kind"], r["value"]): r["attempt"] for r in more.collect()}
        body = body.withColumn(own_col, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:  # many clashes: each text with exceptions gets its own ones by a join
        known = {}
        body = _with_exceptions(body, more, body_col, own_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        make = lru_cache(1 << 14)(s.make)
        for batch in _slices(batches, len(keep)):
            texts, counts = [], []
            for t, own in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                found = detect(t) if t else []
                attempts = known if own is None else {(x["kind"], x["value"]): x["attempt"] for x in own}
                pieces, at = [], 0
                for a, b, kind, value in found:
                    pieces += [t[at:a], s.fit(kind, t[a:b], [make(*x, attempts.get(x, 0)) for x in parts(kind, value)])]
                    at = b
                texts.append("".join([*pieces, t[at:]]) if found else t)
                counts.append(len(found))
            extra = [pa.array(counts, pa.int32())] if count_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), *extra], names=[*keep, text_col, *([count_col] if count_col else [])])

    shape = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text_col))
    shape = shape.withColumn(count_col, F.lit(0)) if count_col else shape
    out = body.select(*[F.col(f"`{c}`") for c in (*keep, body_col, own_col)]).mapInArrow(run, shape.schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if not count_col or c.lower() != count_col.lower()], *([count_col] if count_col else []))


def _with_exceptions(body: DataFrame, table: DataFrame, text_col: str = "__text", own_col: str = "__own") -> DataFrame:
    """body with the list of each text's parts that are in ``table``. A text with very many copies meets its list by broadcast."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *x) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in {p for e in detect(t or "") for p in parts(*e[2:])}]
            yield C.record_batch({"h": [r[0] for r in rows], "kind": [r[1] for r in rows], "value": [r[2] for r in rows]}, f"h long, {_PART}")

    h = C.fresh("h", body.columns)
    hashed = body.withColumn(h, F.xxhash64(text_col))
    mentions = hashed.select(h, text_col).mapInArrow(listed, f"h long, {_PART}").distinct()
    own = mentions.join(table, ["kind", "value"]).groupBy(F.col("h").alias(h)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own_col))
    copies = hashed.groupBy(h).agg(F.count(F.lit(1)).alias("copies of the text"))
    return C.join_keyed(hashed, own.join(copies, h), [h], C.rows_of(body), "copies of the text", "left").drop(h)
