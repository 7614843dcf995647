"""Keyed surrogates for personal data (operator 5).

Entities are found by patterns with checks (Luhn, mod 97, ranges). Each is known
by a canonical value: the digits of a phone number or card, the lower-cased
address, the given name and the surname of a person. That value gets a
replacement of its own type, made by a keyed permutation of its letters and
digits, each within its script; the replacement is then written in the format of
the place where the entity stands. So one key gives one entity the same
surrogate in every spelling and everywhere, which keeps coreference; names
without a title are replaced where the same text holds them with one.
Surrogates that two entities share, or that are entities themselves, are dealt
anew until none collides.
"""

from __future__ import annotations

import hashlib
import heapq
import hmac
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import discard, ship, text_or_empty, text_slices, written

# Titles by the gender of whom they go with, and given names to stand in.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
OTHER_TITLES = ["Dr", "Prof", "Professor", "Doktor"]
MALE_NAMES = ["Adrian", "Bruno", "Conrad", "Dario", "Emil", "Felix", "Gustav", "Henrik", "Ivo", "Jonas", "Karl", "Luis", "Marco", "Nils", "Oskar", "Pablo"]
FEMALE_NAMES = ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"]
OTHER_NAMES = ["Alexis", "Andrea", "Chris", "Dominique", "Jamie", "Jean", "Kim", "Luca", "Maxime", "Nikola", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael"]
GIVEN = {"male": MALE_NAMES, "female": FEMALE_NAMES, "person": OTHER_NAMES}

# Titles after which both surnames may follow, small words within a surname, and endings of made-up given names.
TWO_SURNAMES = ["Señora", "Señor", "Sra", "Sr"]
PARTICLES = ["de", "del", "der", "den", "di", "da", "du", "la", "las", "le", "los", "van", "von", "y", "zu"]
ENDINGS = {"male": ["o", "us", "an", "ik", "er", "en"], "female": ["a", "ia", "ina", "ette", "elle", "ine"], "person": ["i", "y", "e", "is", "ey", "ie"]}
_ONSETS, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"

_TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
_SMALL = "(?:(?:" + "|".join(PARTICLES) + ") ){0,3}"
_WORD = r"\p{Lu}[\p{L}'’\-]+"
PATTERNS = [
    r"(?<![A-Za-z])(?i:token|key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[A-Za-z0-9_\-+/]{16,})",
    r"(?<![A-Za-z0-9])(?P<secret>AKIA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    r"(?P<email>(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}]))",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    r"(?P<card>(?<![\d\-])(?:\d[ \-]?){12,18}\d(?![\d\-]))",
    r"(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))",
    r"(?P<phone>(?<![\p{L}\p{N}])(?:\+\d{8,15}|\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\+1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}-\d{4})(?!\d))",
    r"(?P<phone>(?<![\p{L}\p{N}.\-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4} \d{3,4} \d{3,4}|0\d(?: \d{2}){4}|0\d{2,4}[/ ]\d{5,8})(?![.\-]?[\p{L}\d]))",
    r"\b(?P<title>" + "|".join(TWO_SURNAMES) + r")\.? (?P<name>(?:\p{Lu}\. ?){0,2}" + _SMALL + _WORD + "(?: " + _SMALL + _WORD + r"){0,2})",
    r"\b(?P<title>" + "|".join(_TITLES) + r")\.? (?P<name>(?:\p{Lu}\. ?){0,2}" + _SMALL + _WORD + "(?: " + _SMALL + _WORD + r")?)",
]
#: Where the patterns can start, so a new one needs its own here: at a title or a known kind of key; at digits, maybe with others after one more character; at what ends before a sign, with its most characters.
HEADS = [regex.compile("(?:" + "|".join(_TITLES) + r")\.? "), regex.compile("AKIA"), regex.compile("gh[oprsu]_")]
DIGITS = regex.compile(r"(\d++)([ .\-/](?=\d))?")
_ASSIGNED = regex.compile(r"(?r)(?i:token|key|secret|password|passwd)\s{0,3}")
SIGNS = [("@", regex.compile(r"(?r)[\p{L}\p{N}._%+\-]+"), 64), ("=", _ASSIGNED, 11), (":", _ASSIGNED, 11)]
IN_WORD = regex.compile(r"[\p{L}\p{N}]")
CAPITALISED = regex.compile(r"\p{Lu}[\p{L}\p{N}]*+")


class Entity(NamedTuple):
    """A place in a text; parts are (kind, canonical value, start, end) of what gets a surrogate of its own."""

    start: int
    end: int
    kind: str
    parts: list[tuple[str, str, int, int]]


@cache
def finder() -> regex.Pattern:
    return regex.compile("|".join(PATTERNS))


def canonical(kind: str, value: str) -> str:
    """What all spellings of an entity share."""
    if kind in ("phone", "card", "ssn"):
        return regex.sub(r"[^\d+]", "", value)
    if kind in ("email", "surname", *GIVEN):
        return value.lower() if len(value.lower()) == len(value) else value
    return value.replace(" ", "") if kind == "iban" else value


def _name_parts(text: str, start: int, end: int, kind: str) -> list[tuple[str, str, int, int]]:
    """Initials, a given name by gender where more than one word is left, and surnames; small words aren't parts."""
    words = [(m.start() + start, m.end() + start) for m in regex.finditer(r"[^ .]+", text[start:end])]
    words = [w for w in words if text[slice(*w)] not in PARTICLES]
    whole = [w for w in words if w[1] - w[0] > 1] or words[-1:]
    out = []
    for w in words:
        part = "initial" if w not in whole else kind if w == whole[0] and len(whole) > 1 else "surname"
        out.append((part, text[slice(*w)] if part == "initial" else canonical(part, text[slice(*w)]), *w))
    return out


def _digit_starts(text: str) -> Iterator[int]:
    """Where patterns of digits can start: at a number, the sign or bracket before it, or the two capitals of an IBAN.

    Those that start at the number itself have 13 digits in one or more numbers."""
    for m in DIGITS.finditer(text):
        i, j = m.span(1)
        before = text[i - 1 : i]
        if before in ("+", "("):
            yield i - 1
        elif before.isupper() and i > 1:
            yield i - 2
        if m[2] or j - i > 12:
            yield i


def _sign_starts(text: str, sign: str, ahead: regex.Pattern, most: int) -> Iterator[int]:
    """Where that starts which ends before a sign."""
    at = text.find(sign)
    while at >= 0:
        if m := ahead.match(text[max(at - most, 0) : at]):
            yield at - len(m[0])
        at = text.find(sign, at + 1)


def starts(text: str) -> Iterator[int]:
    """Every place where a pattern can start, in order, and some where none does.

    Quick searches find them, so that the patterns are tried there only and not at every letter."""
    heads = ((m.start() for m in head.finditer(text)) for head in HEADS)
    return heapq.merge(_digit_starts(text), *(_sign_starts(text, *x) for x in SIGNS), *heads)


def matches(text: str) -> Iterator[regex.Match]:
    """What finder() finds in a text from left to right."""
    find, at = finder().match, 0
    for i in starts(text):
        if i >= at and (m := find(text, i)):
            at = m.end()
            yield m


def _known(text: str, names: Iterable[str]) -> Iterator[tuple[int, int]]:
    """Where names stand as whole words, from left to right, none overlapping, the longest first; each starts with a capital."""
    by_word: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        by_word.setdefault(CAPITALISED.match(name)[0], []).append(name)
    end = 0
    for m in CAPITALISED.finditer(text):
        i = m.start()
        if i < end or m[0] not in by_word or (i and IN_WORD.match(text, i - 1)):
            continue
        if name := next((x for x in by_word[m[0]] if text.startswith(x, i) and not IN_WORD.match(text, i + len(x))), None):
            end = i + len(name)
            yield i, end


def spans(text: str) -> list[Entity]:
    """The entities of a text, in order, none overlapping."""
    out, people = [], {}
    for m in matches(text):
        kind = next(k for k in ("secret", "email", "iban", "ip", "card", "ssn", "phone", "name") if m.span(k)[0] >= 0)
        i, j = m.span(kind)
        if kind == "name":
            title = m["title"]
            kind = "male" if title in MALE_TITLES else "female" if title in FEMALE_TITLES else "person"
            parts = _name_parts(text, i, j, kind)
            given = next((p for p in parts if p[0] == kind), None)
            for p in parts:
                if p[0] == "surname":
                    people.setdefault(text[p[2] : p[3]])
                    if given:  # the whole name up to this surname
                        people[text[given[2] : p[3]]] = kind
        else:
            parts = [(kind, canonical(kind, text[i:j]), i, j)]
        out.append(Entity(i, j, kind, parts))
    if people:  # the same people without a title, whole names first
        taken, at = sorted((e.start, e.end) for e in out), 0
        for i, j in _known(text, people):
            while at < len(taken) and taken[at][1] <= i:
                at += 1
            if at == len(taken) or j <= taken[at][0]:
                kind = people[text[i:j]] or "person"
                out.append(Entity(i, j, kind, _name_parts(text, i, j, kind)))
        out.sort()
    return out


class Stream:
    """Numbers from a keyed hash of an entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.count, self.left = key, f"{kind}\0{value}\0{attempt}".encode(), 0, 0
        self.pool = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 32:
            self.pool = int.from_bytes(hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.left, self.count = 1 << 256, self.count + 1
        x, self.pool, self.left = self.pool % n, self.pool // n, self.left // n
        return x


@cache
def _alphabet(script: str, upper: bool) -> str:
    """Letters of a script in one case."""
    blocks = {"GREEK": range(0x391, 0x3CA), "CYRILLIC": range(0x410, 0x450), "HEBREW": range(0x5D0, 0x5EB), "ARABIC": range(0x627, 0x64B), "CJK": range(0x4E00, 0x5000), "HIRAGANA": range(0x3042, 0x3094), "KATAKANA": range(0x30A2, 0x30F4), "HANGUL": range(0xAC00, 0xAE00)}
    letters = [chr(c) for c in blocks.get(script, range(0x61, 0x7B)) if chr(c).isalpha()]
    if script not in blocks and upper:
        letters = [x.upper() for x in letters]
    cased = [x for x in letters if x.isupper() == upper and x.islower() != upper]
    return "".join(cased or letters)


def _letter(x: str, s: Stream) -> str:
    if x.isdigit():
        return str(s.below(10)) if x.isascii() else x
    if not x.isalpha():
        return x
    script = unicodedata.name(x, "LATIN").split()[0]
    letters = _alphabet(script, x.isupper())
    return letters[s.below(len(letters))]


def _luhn(digits: str) -> int:
    total = sum((int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _check97(value: str) -> int:
    """An IBAN's remainder; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _given(kind: str, attempt: int, s: Stream) -> str:
    """A given name in lower case: of the stock at first, then made up, a syllable longer every other attempt.

    Three syllables give some ten thousand names a gender, each further one 90 times as many."""
    if not attempt:
        return GIVEN[kind][s.below(len(GIVEN[kind]))].lower()
    made = "".join(_ONSETS[s.below(len(_ONSETS))] + _VOWELS[s.below(len(_VOWELS))] for _ in range(1 + (attempt - 1) // 2))
    return made + _ONSETS[s.below(len(_ONSETS))] + ENDINGS[kind][s.below(len(ENDINGS[kind]))]


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """A replacement of the same kind for a canonical value; other attempts give other ones."""
    s = Stream(key, kind, value, attempt)
    if kind in GIVEN and unicodedata.name(value[0], "LATIN").startswith("LATIN"):
        return "-".join(_given(kind, attempt, s) for _ in value.split("-"))  # double names stay double
    if kind == "email":
        name, _, host = value.rpartition("@")
        labels = host.split(".")
        return "".join(_letter(x, s) for x in name) + "@" + ".".join(["".join(_letter(x, s) for x in part) for part in labels[:-1]] + labels[-1:])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "iban":
        body = "".join(_letter(x, s) for x in value[4:])
        valid = value.isalnum() and _check97(value) == 1
        return value[:2] + (f"{98 - _check97(value[:2] + '00' + body):02d}" if valid else "".join(_letter(x, s) for x in value[2:4])) + body
    if kind == "phone" and value.startswith("+"):
        country = 2 if value[1] in "17" else 3  # the code's first digits tell the country
        return value[:country] + "".join(_letter(x, s) for x in value[country:])
    if kind == "phone" and value.startswith("0"):
        return "0" + "".join(_letter(x, s) for x in value[1:])
    if kind == "secret" and regex.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    out = "".join(_letter(x, s) for x in value)
    if kind == "card" and _luhn(value[:-1] + "0") == int(value[-1]):  # a valid check digit stays valid
        out = out[:-1] + str(_luhn(out[:-1] + "0"))
    return out


def render(kind: str, shown: str, made: str) -> str:
    """The surrogate of a canonical value in the format of the place: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        own = iter(made)
        keep = (lambda c: c.isdigit() or c == "+") if kind != "iban" else (lambda c: c != " ")
        return "".join(next(own) if keep(c) else c for c in shown)
    if kind in ("email", "surname") and len(made) == len(shown):
        return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for c, m in zip(shown, made, strict=True))
    if kind in GIVEN:
        return made.upper() if shown.isupper() and len(shown) > 1 else "-".join(x[:1].upper() + x[1:] if shown[:1].isupper() else x for x in made.split("-"))
    return made


ENTITY = "kind string, value string"


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, canonical value) of all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = sorted({p[:2] for t in b.column(0).to_pylist() for e in spans(t) for p in e.parts if p[0] != "initial"})
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.string()) for n in (0, 1)], ["kind", "value"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, ENTITY).distinct()


def resolved(found: DataFrame) -> DataFrame:
    """found(kind, value) with `final`: a given name has one gender wherever it stands.

    It is the one that its titles tell, neither where they tell both or none."""
    given = found.where(F.col("kind").isin(*GIVEN)).groupBy("value").agg(F.max((F.col("kind") == "male").cast("int")).alias("m"), F.max((F.col("kind") == "female").cast("int")).alias("f"))
    final = F.when(~F.col("kind").isin(*GIVEN) | F.col("m").isNull(), F.col("kind")).when(F.col("m") > F.col("f"), "male").when(F.col("f") > F.col("m"), "female").otherwise("person")
    return found.join(given, "value", "left").select("kind", "value", final.alias("final"))


def assign(found: DataFrame, key: bytes, most_attempts: int = 50) -> DataFrame:
    """(kind, value, surrogate, attempt) of each distinct entity, no surrogate twice nor an entity's own text.

    Of entities that share a surrogate, that with the least attempt stays (ties:
    the least kind and value); the others try again. A round looks at those that
    try only: what is settled stays as it is."""
    known = written(found.select("kind", "value").distinct(), "pii-entities")
    own = known.select(F.col("value").alias("surrogate")).distinct()
    settled, todo = None, known.withColumn("attempt", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            made = [surrogate(key, k, v, a) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    for _ in range(most_attempts):
        tried = written(todo.select("kind", "value", "attempt").mapInArrow(run, f"{ENTITY}, attempt int, surrogate string"), "pii-tried")
        free = tried.join(own, "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled.select("surrogate"), "surrogate", "left_anti")
        first = free.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("f"))
        good = written(first.select("f.*", "surrogate").join(tried.select("kind", "value", "attempt"), ["kind", "value"]).select("kind", "value", "surrogate", "attempt"), "pii-settled")
        settled = good if settled is None else settled.union(good)
        todo = written(tried.join(good, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "pii-todo")
        discard(tried)
        if not todo.take(1):
            return settled
    raise RuntimeError("surrogates still collide: more entities than their format has values")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities) of every row, each entity replaced by its surrogate.

    n_entities counts places, a name with its title's whole name as one. Names
    are the same person's in any title and case. Only entities that took more
    than one attempt, and given names whose gender other titles tell, travel to
    their documents; all others are made anew where they stand. Initials become another letter each,
    without a check for collisions. Null texts count as empty and come back
    empty; repeated rows repeat; an id may be null; other columns are left out;
    no rows give no rows."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    found = written(resolved(written(entities(docs, text_col), "pii-seen")), "pii-found")  # the texts are searched once for both
    dealt = assign(found.select(F.col("final").alias("kind"), "value"), key).select(F.col("kind").alias("final"), "value", "attempt")
    retried = written(found.join(dealt, ["final", "value"]).where("attempt > 0 OR final <> kind"), "pii-retried").select("kind", "value", "final", "attempt")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    if not retried.take(1):
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,value:string,final:string,attempt:int>>"))
    else:
        def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches):
                found = [(h, k, v) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, v in sorted({p[:2] for e in spans(t) for p in e.parts})]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[n] for x in found], pa.string()) for n in (1, 2))], ["h", "kind", "value"])

        marked = rows.withColumn("h", F.xxhash64("text"))
        met = marked.select("h", "text").mapInArrow(where, f"h bigint, {ENTITY}").distinct().join(retried, ["kind", "value"])
        again = met.groupBy("h").agg(F.collect_set(F.struct("kind", "value", "final", "attempt")).alias("again"))
        rows = marked.join(written(again, "pii-again"), "h", "left").select("id", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts, counts = [], []
            for t, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                dealt = {(x["kind"], x["value"]): (x["final"], x["attempt"]) for x in again or ()}
                out, at, found = [], 0, spans(t)
                for k, v, i, j in (p for e in found for p in e.parts):
                    final, attempt = dealt.get((k, v), (k, 0))
                    out += [t[at:i], render(final, t[i:j], surrogate(key, final, v, attempt))]
                    at = j
                texts.append("".join([*out, t[at:]]))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "text", "n_entities"])

    return rows.mapInArrow(run, f"id {kind}, text string, n_entities int").withColumnRenamed("id", id_col)
