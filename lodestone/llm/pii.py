"""Personal information inside free text.

Transducers rewrite the text step by step (escapes, lookalike letters, spelled digits, at/dot
disguises) and keep, for every character they emit, the position it came from. Identifiers are
found in the rewritten text; their spans map back to the stored one, which stays as it was but for
the placeholders.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise, ship

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοερτυικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaoeptuikvABEZHIKMNOPTYX"))
INVISIBLE = set("​‌‍⁠﻿­")
# Digit words.
DIGIT_WORDS = {
    w: str(d)
    for row in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(row.split())
}
DIGIT_WORDS |= {"oh": "0", "zwo": "2"}
# Words of account names that belong to no person.
ROLES = set(
    "account admin agent app automation bot build ci daemon deleted deploy desk farm former gate guest import job "
    "night pipeline platform quality queue release robot runner scheduled service shift support sync system team "
    "test tickets unknown user webhook worker billing external".split()
)
PARTICLES = {"de", "la", "las", "los", "del", "van", "von", "der", "den", "di", "da", "du", "le", "ter", "zu", "al", "el", "dos"}


class Mapped:
    """A text and the source position of each of its characters (None: the same)."""

    def __init__(self, text: str, at: list[int] | None = None):
        self.text, self.at = text, at

    def source(self, i: int) -> int:
        return i if self.at is None else self.at[i]

    def rewrite(self, pattern: re.Pattern, to) -> Mapped:
        """Replace matches; new characters point to the start of what they replace, or to the places
        in it that ``to`` gives along with them."""
        out: list[str] = []
        at: list[int] = []
        upto, old = 0, self.at or range(len(self.text))
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            new, places = new if isinstance(new, tuple) else (new, [0] * len(new))
            out += [self.text[upto : m.start()], new]
            at.extend(old[upto : m.start()])
            at.extend(old[m.start() + p] for p in places)
            upto = m.end()
        if not out:
            return self
        at.extend(old[upto:])
        return Mapped("".join(out) + self.text[upto:], at)


ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(["\\/bfnrt]))')
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});")
ODD = re.compile(r"[^\x00-\x7fÀ-ÿ]")
DIGITS = re.compile(r"(?<![^\W_])(?:(?:%s)(?:[ ,.-]{1,2}(?=\w)|(?![^\W_]))){5,}" % "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)), re.I)
LABEL = r"[\w+%-]+"
SAID_AT = re.compile(
    rf"(?<![\w.+-])(?>{LABEL}(?:(?: dot |\.){LABEL})*+) at (?>[\w-]+(?:(?: dot |\.)[\w-]+)*+ dot [A-Za-z]{{2,}}|[\w-]+(?: dot [\w-]+)++)(?![\w])(?! at \w)"
)
BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|ät|arroba)\s?[\])}>]\s?", re.I)
BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|punkt|punto|point)\s?[\])}>]\s?", re.I)
SAID = re.compile(r" (at|dot) ")
BRACKETED = re.compile(r"[\[({<] ?(?:at|ät|arroba)\b", re.I)


def _plain(m: re.Match) -> str | None:
    ch = m[0]
    if ch in INVISIBLE:
        return ""
    new = LOOKALIKES.get(ch) or unicodedata.normalize("NFKC", ch)
    return new if new != ch and len(new) == 1 else None


def _digits(m: re.Match) -> tuple[str, list[int]]:
    """One digit a word, each from where its word begins."""
    found = [(DIGIT_WORDS[w[0].lower()], w.start()) for w in re.finditer(r"[^\W\d_]+", m[0])]
    blank = [(" ", len(m[0]) - 1)] if m[0][-1] in " ,.-" else []
    return "".join(d for d, _ in found + blank), [at for _, at in found + blank]


def unveil(text: str) -> Mapped:
    """Escapes, entities and lookalikes; each step does nothing where its signs are absent."""
    m = Mapped(text)
    if "\\" in text and text.lstrip()[:1] == "{":
        names = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}
        m = m.rewrite(ESCAPE, lambda e: chr(int(e[1], 16)) if e[1] else names.get(e[2], e[2]))
    if "&" in m.text:
        m = m.rewrite(ENTITY, lambda e: (lambda x: x if len(x) == 1 else None)(html.unescape(e[0])))
    if not m.text.isascii():
        m = m.rewrite(ODD, _plain)
    return m


def undisguise(m: Mapped, digits: bool) -> Mapped:
    """Spelled digits, and the at and dot of disguised addresses."""
    if digits:
        m = m.rewrite(DIGITS, _digits)
    if BRACKETED.search(m.text):
        m = m.rewrite(BRACKET_AT, lambda e: "@").rewrite(BRACKET_DOT, lambda e: ".")
    if " dot " in m.text and " at " in m.text:
        # the disguised address shrinks in place: its words keep their own positions
        spans = [s.span() for s in SAID_AT.finditer(m.text)]
        if spans:
            inside = lambda i: any(a <= i < b for a, b in spans)
            m = m.rewrite(SAID, lambda e: {"at": "@", "dot": "."}[e[1]] if inside(e.start()) else None)
    return m


EMAIL = re.compile(r"(?<![\w.+%-])[^\W_](?:[\w.+%-]*[\w+%-])?@(?=[\w.-]*[A-Za-z])[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w@])(?!:[\w~/])")
# The first character stands before its look-behind: a scan then jumps from one such character to the next.
PHONE = re.compile(
    r"[+(\d](?<![\w.,:/#+-].)(?:(?<=\+)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,8}(?:[ .-]\d{2,8}){0,5}"
    r"|(?<=0)0[1-9]\d{8,13}|(?<=0)0[1-9]\d{0,2}(?:[ .-]\d{2,5}){2,5}"
    r"|(?:(?<=\()\d{3}\)[ .-]?|(?<=\d)\d{2}[ .-])\d{3}[ .-]\d{4}"
    r"|(?:(?<=\()0|(?<=0))\d{1,4}\)?[ /-]\d{3,8}(?:[ -]\d{2,5}){0,4})(?![\w]|[-.:]\d)", re.S
)
SPELLED = re.compile(r"(?<!\w)\d{7,14}(?!\w)")
_ID = (
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{3}[- ]?\d{2}[- ]?\d{4}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{8} ?-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{2}[A-Z]{2}\d{5}|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]{1,2} ?\d{6,8}|\d{9,12}"
)
# Labels before identity numbers.
ID_LABEL = (
    "ssn", "social security", "nino", "ni number", "national insurance", r"steuer-?id(?:entifikationsnummer|nr\.?)?", "steuernummer", "tax id", "dni", "nie", "nif", "documento", "passport", "reisepass", "passeport", "pasaporte",
    r"carte d['’]identit[ée]", "personalausweis", "id card", r"num[ée]ro fiscal", "insee",
)
ID_LABELLED = re.compile(
    rf"[{''.join(sorted({c for x in ID_LABEL for c in (x[0], x[0].upper())}))}](?<![^\W_].)(?i:{'|'.join(f'(?<={x[0]}){x[1:]}' for x in ID_LABEL)})"
    r"(?:\s*(?i:no\.?|nr\.?|num(?:ber|mer|éro|ero)|n[º°]|id|:|#|=|-))*\s*(" + _ID + r")(?![\w]|-\d)", re.S
)
ID_PLAIN = re.compile(
    r"[\dA-CEGHJ-PR-TW-ZQ](?<![\w.-].)(?:(?<=\d)\d{2}-\d{2}-\d{4}|(?<=[A-CEGHJ-PR-TW-Z])[A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|(?<=Q)Q ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w]|-\d)", re.S
)
_CITY = r",\s+(?:\d{4,5}\s+)?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?"
ADDRESS = re.compile(
    r"(?<![\w.,/#-])(?:"
    r"(?:(?:Flat|Apt|Apartment|Unit|Suite) \d+\w?, )?\d{1,5}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’.-]+ ){1,4}?"
    r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Close|Terrace|Place|Pl|Square|Sq|Way|Crescent|Gardens|Row|Mews|Parkway|Pkwy|Hill|Walk|Grove)\.?"
    r"(?:,? (?:Apt|Apartment|Suite|Unit|#) ?\d+\w?)?" + _CITY + r"|"
    r"\d{1,4}[a-z]?(?: (?:bis|ter|quater))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|square|route) [^,\n\"<>{}]{2,40}" + _CITY + r"|"
    r"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|C/|Ronda|Travesía) ?[^,\n\"<>{}\d]{2,40},? \d{1,4}\w?(?:, ?\d+ ?[ºªo°] ?[A-Z]?)?" + _CITY + r"|"
    r"[A-ZÄÖÜ][\wäöüß-]*(?:str\.|straße|strasse|weg|gasse|allee|platz|ring|damm|ufer|steig) ?\d{1,4} ?[a-z]?" + _CITY + r"|"
    r"(?:[A-ZÄÖÜ][\wäöüß-]* )(?:Straße|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer) \d{1,4} ?[a-z]?" + _CITY + r")"
)
# A word by which one of the forms of ADDRESS names a street; C/ is looked for in the text.
STREET = re.compile(
    r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Close|Terrace|Place|Pl|Square|Sq|Way|Crescent|Gardens|Row|Mews|Parkway|Pkwy|Hill|Walk|Grove)\Z"
    r"|(?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|square|route)\Z|(?:Calle|Avenida|Avda|Plaza|Paseo|Camino|Carrera|Ronda|Travesía)"
    r"|.*(?i:str|straße|strasse|weg|gasse|allee|platz|ring|damm|ufer|steig)\Z", re.S
)
DIGITY = re.compile(r"\d")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def fold(word: str) -> str:
    """Case and accents do not tell names apart."""
    w = word.casefold().replace("’", "'")
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


# A filter of 32 bits a key and 8 probes takes a word for a key once in 170,000 words.
PER_KEY, PROBES = 32, 8
LEAST_BITS, MOST_BITS, BLOCK = 1 << 16, 1 << 30, 1 << 23
GIVEN, SURNAME, TAIL, GIVEN_TAIL = "g", "s", "t", "u"
TAIL_SIZE, GIVEN_TAIL_SIZE, TAIL_NAMES = 3, 3, 3


def size_for(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two between fixed bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (PER_KEY * max(1, keys) - 1).bit_length()))


def slots(kind: str, key: str, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(f"{kind}:{key}")
    step = h >> 33 | 1
    return [(h + i * step) & (bits - 1) for i in range(PROBES)]


DIGIT, LABELS, STREETS, ALONE, PARTICLE = 16, 32, 64, 128, 256
# A word, or its part behind an apostrophe, that some label in ID_LABELLED begins: compounds as well.
LABEL_START = re.compile(r"(?<![^\W_])(?i:ssn|social|nino|ni|national|steuer|tax|dni|nie|nif|documento|passport|reisepass|passeport|pasaporte|carte|personalausweis|id|num[ée]ro|insee)")


class Kinds(dict):
    """What a word may be part of: 1 given name, 2 surname, 4 ending of surnames, 8 ending of given
    names, 16 digit word, 32 start of a label of an identity number, 64 name of a street, 128 a
    capital alone, 256 particle of a surname; 0 none. ``denied`` keys are in the filter by mistake."""

    def __init__(self, bits: np.ndarray, denied: frozenset = frozenset()):
        self.bits, self.size, self.denied = bits, 8 * len(bits), denied

    def _has(self, kind: str, key: str) -> bool:
        return all(self.bits[s >> 3] >> (7 - (s & 7)) & 1 for s in slots(kind, key, self.size)) and f"{kind}:{key}" not in self.denied

    def __missing__(self, word: str) -> int:
        key, k = fold(word), 0
        if key not in ROLES and len(key) > 1:
            k = self._has(GIVEN, key) + 2 * self._has(SURNAME, key)
            if word[0].isupper():
                k += 4 * (len(key) > TAIL_SIZE + 1 and self._has(TAIL, key[-TAIL_SIZE:]))
                k += 8 * (len(key) > GIVEN_TAIL_SIZE + 1 and self._has(GIVEN_TAIL, key[-GIVEN_TAIL_SIZE:]))
        low = word.lower()
        k += DIGIT * (low in DIGIT_WORDS) + LABELS * bool(LABEL_START.search(word)) + STREETS * bool(STREET.match(word))
        k += ALONE * (len(word) == 1 and word.isupper()) + PARTICLE * (low in PARTICLES)
        if len(self) < 1_000_000:
            self[word] = k
        return k

    def keys_of(self, words: list[str]) -> list[str]:
        """The keys of the filter that make these words parts of names."""
        out = []
        for word in words:
            k, key = self[word], fold(word)
            out += [f"{kind}:{part}" for bit, kind, part in ((1, GIVEN, key), (2, SURNAME, key), (4, TAIL, key[-TAIL_SIZE:]), (8, GIVEN_TAIL, key[-GIVEN_TAIL_SIZE:])) if k & bit]
        return out


class Lexicon:
    """Names as a Bloom filter sized by their number; ``keys`` (driver only) are the names themselves."""

    def __init__(self, bits: np.ndarray, keys: DataFrame | None = None, denied: frozenset = frozenset()):
        self.bits, self.keys, self.denied = bits, keys, denied
        self.kinds = Kinds(bits, denied)

    def without(self, denied: frozenset) -> Lexicon:
        return Lexicon(self.bits, self.keys, self.denied | denied)

    def __getstate__(self):
        return {"bits": self.bits, "denied": self.denied}

    def __setstate__(self, state):
        self.__init__(state["bits"], None, state["denied"])


def _blank(gap: str) -> bool:
    return gap in (" ", "  ", " ", "\t")


def names_in(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Spans of a surname with a given name or initial, in either order and any case."""
    toks = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    kinds = [lexicon.kinds[w] for _, _, w in toks]
    n = len(toks)

    def gap(i: int) -> str:
        return text[toks[i][1] : toks[i + 1][0]] if i + 1 < n else "\0"

    def given(i: int) -> int | None:
        """Index after the given names that begin at i, or None."""
        if i >= n or not kinds[i] & 9:
            return None
        while gap(i) == "-" and kinds[i + 1] & 9:
            i += 1
        return i + 1

    def initials(i: int) -> int:
        while i + 1 < n and len(toks[i][2]) == 1 and toks[i][2].isupper() and gap(i) in (". ", ".", " "):
            i += 1
        return i

    def surname(i: int, strict: bool) -> int | None:
        """Index after the surname (with particles) that begins at i, or None."""
        while i + 1 < n and toks[i][2].lower() in PARTICLES and _blank(gap(i)):
            i += 1
        if i >= n:
            return None
        if kinds[i] & 2 or (not strict and kinds[i] & 4):
            while gap(i) == "-" and kinds[i + 1] & 2:
                i += 1
            return i + 1
        return None

    found, i = [], 0
    while i < n:
        if not kinds[i] & (15 | ALONE | PARTICLE):
            i += 1
            continue
        end = None
        j = given(i)
        if j is not None and j < n and _blank(gap(j - 1)):
            strict = not toks[i][2][0].isupper()
            end = surname(initials(j), strict)
        if end is None and kinds[i] & ALONE and i + 1 < n and gap(i) in (". ", "."):
            j = initials(i)
            end = surname(j, False) if j > i else None
        if end is None and kinds[i] & (6 | PARTICLE):
            j = surname(i, False)
            if j is not None and j < n:
                between = gap(j - 1)
                if between in (", ", ","):
                    end = given(j)
                    if end is None and len(toks[j][2]) == 1 and toks[j][2].isupper() and text[toks[j][1] : toks[j][1] + 1] == ".":
                        end = j + 1
                elif _blank(between) and kinds[i] & 2 and kinds[j] & 1:
                    end = given(j)
                    if end is not None and end < n and _blank(gap(end - 1)) and surname(initials(end), False):
                        end = None
        if end is None:
            i += 1
        else:
            found.append((toks[i][0], toks[end - 1][1]))
            i = end
    return found


def find(text: str | None, lexicon: Lexicon, whole_name: bool = False) -> list[tuple[str, int, int]]:
    """(type, start, end) of all personal information, positions in the stored text.

    ``whole_name``: the text is an account's name, so its form alone may show a person.
    """
    if not text:
        return []
    m = unveil(text)
    kinds = list(map(lexicon.kinds.__getitem__, WORD.findall(m.text)))
    any_of = reduce(or_, set(kinds), 0)
    spelled = bool(any_of & DIGIT) and sum(1 for k in kinds if k & DIGIT) >= 5
    m = undisguise(m, spelled)
    t = m.text
    taken = Spans()
    if "@" in t:
        taken.take("email", (x.span() for x in EMAIL.finditer(t)))
    if DIGITY.search(t):
        if any_of & STREETS or "C/" in t:
            taken.take("address", (x.span() for x in ADDRESS.finditer(t)))
        if any_of & LABELS:
            taken.take("id_number", (x.span(1) for x in ID_LABELLED.finditer(t)))
        taken.take("id_number", (x.span() for x in ID_PLAIN.finditer(t)))
        taken.take("phone", (x.span() for x in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in x[0]) <= 16))
        if spelled:
            taken.take("phone", (x.span() for x in SPELLED.finditer(t) if m.source(x.end() - 1) - m.source(x.start()) >= 2 * (x.end() - x.start())))
    if any_of & 6:
        taken.take("name", names_in(t, lexicon))
    if whole_name and "name" not in taken.kinds and name_pairs(t):
        m2 = PERSON.match(t)
        taken.take("name", [(len(t) - len(t.lstrip()), m2.end())])
    return sorted((k, m.source(a), m.source(b) if b < len(t) else len(text)) for a, b, k in zip(taken.starts, taken.ends, taken.kinds))


class Spans:
    """Spans that do not overlap, in order of position; the first one taken stays."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []

    def take(self, kind: str, spans) -> None:
        for a, b in spans:
            i = bisect_left(self.starts, a)
            if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
                continue
            self.starts.insert(i, a)
            self.ends.insert(i, b)
            self.kinds.insert(i, kind)


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with a placeholder of its type for each find and nothing else changed."""
    if not found:
        return text
    out, upto = [], 0
    for kind, a, b in sorted(found, key=lambda f: f[1]):
        if a >= upto:
            out.append(text[upto:a])
            out.append(f"[{kind.upper()}]")
            upto = b
    return "".join(out) + text[upto:]


PERSON = re.compile(
    r"\s*(?:(?P<g1>[^\W\d_]+)(?:-[^\W\d_]+)?(?: [^\W\d_]\.)? (?:(?:de|la|las|van|von|der|den|del|di|da) )*(?P<s1>[^\W\d_]+(?:['’][^\W\d_]+)?)"
    r"|(?:(?:de|la|las|van|von|der|den|del|di|da) )*(?P<s2>[^\W\d_]+(?:['’][^\W\d_]+)?), (?P<g2>[^\W\d_]+)(?:-[^\W\d_]+)?)"
    r"(?=$|\s*[/(\[]| - |\s+[+(\d])"
)


def name_pairs(name: str | None) -> list[tuple[str, str]]:
    """(given, surname) keys of a display name; none for accounts of no person."""
    m = PERSON.match(name or "")
    if not m:
        return []
    g, s = fold(m["g1"] or m["g2"]), fold(m["s1"] or m["s2"])
    if g in ROLES or s in ROLES or len(g) < 2 or len(s) < 2:
        return []
    return [(g, s)]


def name_keys(people: DataFrame, column: str = "display_name") -> DataFrame:
    """(key) of the given names, surnames and endings that the display names of all rows show.

    An ending counts if ``TAIL_NAMES`` different names have it.
    """
    ship(people.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for name in batch.column(0).to_pylist() for p in name_pairs(name)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["g", "s"]
            )

    named = people.select(column).filter(F.col(column).isNotNull()).distinct().mapInArrow(parse, "g string, s string")
    parts = named.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in ((GIVEN, "g"), (SURNAME, "s"))]))).distinct()
    size = F.when(F.col("kind") == GIVEN, GIVEN_TAIL_SIZE).otherwise(TAIL_SIZE)
    ending = F.when(F.col("kind") == GIVEN, GIVEN_TAIL).otherwise(TAIL)
    parts = materialise(parts, "names")
    tails = parts.filter(F.length("name") > size).groupBy(F.concat_ws(":", ending, F.substring("name", -size, size)).alias("key")).count()
    return parts.select(F.concat_ws(":", "kind", "name").alias("key")).union(tails.filter(F.col("count") >= TAIL_NAMES).select("key"))


def learn_names(people: DataFrame, column: str = "display_name") -> Lexicon:
    """The names that the display names of all rows show, as a filter sized by their number.

    It is built in blocks where the names are; the driver gets packed blocks, ``MOST_BITS`` bits at
    most. Beyond ``MOST_BITS`` / ``PER_KEY`` names it errs more often, and :func:`scanned` checks more.
    """
    spark = people.sparkSession
    keys = materialise(name_keys(people, column), "name-keys")
    bits = size_for(keys.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([s for key in batch.column(0).to_pylist() for s in slots(key[0], key[2:], bits)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], names=["block", "bit"])

    def packed(table: pa.Table) -> pa.Table:
        own = np.zeros(min(BLOCK, bits), bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block").slice(0, 1).cast(pa.int32()), "bytes": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    blocks = keys.mapInArrow(hashed, "block int, bit int").distinct().groupBy("block").applyInArrow(packed, "block int, bytes binary")
    for row in blocks.toLocalIterator():
        own = np.frombuffer(row["bytes"], np.uint8)
        out[row["block"] * (BLOCK // 8) : row["block"] * (BLOCK // 8) + len(own)] = own
    return Lexicon(out, keys)


def _scan(comments: DataFrame, lexicon: Lexicon, key: str, fields: tuple[str, ...], people: str) -> DataFrame:
    """(key, field_name, pii_type, start_pos, _keys): each find and the filter's keys that made it."""
    shared = comments.sparkSession.sparkContext.broadcast(lexicon)  # MOST_BITS at most
    kind = comments.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen: dict[str | None, list] = {}  # finds of names that come again and again

        def found(text: str | None, whole_name: bool) -> list[tuple[str, int, int]]:
            if not whole_name:
                return find(text, own)
            if text not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[text] = find(text, own, True)
            return seen[text]

        for batch in batches:
            rows: list[tuple] = []
            for n, name in enumerate(fields):
                for k, text in enumerate(batch.column(n + 1).to_pylist()):
                    for what, a, b in found(text, name == people):
                        rows.append((k, name, what, a, own.kinds.keys_of(WORD.findall(unveil(text[a:b]).text)) if what == "name" else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))],
                names=[key, "field_name", "pii_type", "start_pos", "_keys"],
            )

    return comments.select(key, *fields).mapInArrow(run, f"{key} {kind}, field_name string, pii_type string, start_pos bigint, _keys array<string>")


def scanned(comments: DataFrame, lexicon: Lexicon, key: str, fields: tuple[str, ...], people: str) -> tuple[DataFrame, Lexicon]:
    """All finds, none of which rests on a mistake of the filter, and the lexicon that knows them.

    The few keys that finds rest on are joined to the names themselves. Rows with a find that
    rests on a wrong key are scanned again without those keys, until there are none.
    """
    found, todo = None, comments
    while True:
        some = materialise(_scan(todo, lexicon, key, fields, people), "finds")
        used = some.select(F.explode("_keys").alias("_key")).distinct()
        wrong = used.join(lexicon.keys.withColumnRenamed("key", "_key"), "_key", "left_anti")
        bad = frozenset(r[0] for r in wrong.collect())  # mistakes of the filter: a fixed share of the words
        if not bad:
            return (some if found is None else found.unionByName(some)), lexicon
        lexicon = lexicon.without(bad)
        lost = materialise(some.select(key, F.explode("_keys").alias("_key")).join(wrong, "_key", "left_semi").select(key).distinct(), "finds-again")
        good = some.join(lost, key, "left_anti")
        found = good if found is None else found.unionByName(good)
        todo = todo.join(lost, key, "left_semi")


def personal_information(comments: DataFrame, key: str = "fetch_id", fields: tuple[str, ...] = ("body", "display_name"), people: str = "display_name") -> DataFrame:
    """(fetch_id, field_name, pii_type, start_pos), one row per find, positions in code points.

    Repeated rows count once; null and empty texts hold nothing. Texts stay where they are: only
    the finds are shuffled.
    """
    ship(comments.sparkSession)
    found, _ = scanned(comments, learn_names(comments, people), key, fields, people)
    return found.drop("_keys").distinct()


def redacted(comments: DataFrame, key: str = "fetch_id", fields: tuple[str, ...] = ("body", "display_name"), people: str = "display_name") -> DataFrame:
    """The rows with each find replaced by a placeholder of its type; nulls stay null.

    A first scan tells the filter's mistakes, so that nothing is replaced by mistake.
    """
    spark = comments.sparkSession
    ship(spark)
    _, lexicon = scanned(comments, learn_names(comments, people), key, fields, people)
    shared = spark.sparkContext.broadcast(lexicon)  # MOST_BITS at most
    kind = comments.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [
                pa.array([redact(t, find(t, shared.value, f == people)) for t in batch.column(n + 1).to_pylist()], pa.string())
                for n, f in enumerate(fields)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *fields])

    return comments.select(key, *fields).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{f} string" for f in fields))
