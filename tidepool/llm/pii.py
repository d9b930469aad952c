"""Personal information in free text: normalised with offsets, detected, mapped back to the characters as stored.

A first transducer writes each stored character as its plain form (one width, no accents, look-alikes as Latin letters,
unseen characters as nothing) and keeps where each plain character came from; a second one rewrites disguised at-signs and
dots and spelled digits. Detectors run on the plain text, and their spans are read back through the offsets. Check
characters of identity numbers are computed. Person names come from the lexicon and from names that stand beside known
ones in the corpus, which is learned from all texts first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.textform import DROPPED, HYPHENS, LOOKALIKES, SPACES

ROWS = 2_000
#: Mentions beside known names, and names of the other kind beside it, from which a word counts as a name.
BESIDE, PARTNERS = 3, 2
#: Counts a worker holds before it hands them on.
HELD = 200_000
#: A name that stands in a person's name in less than this part of its occurrences is also an ordinary word.
ORDINARY = 0.3

# Titles before a family name.
TITLES = frozenset("dr prof mr mrs ms mx herr frau fraulein sr sra srta senor senora monsieur madame mme mlle don dona miss sir signor signora dott".split())
# Check letters of the Spanish numbers by remainder, and of the Italian code.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CODICE_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23), strict=True))
# Digits as words.
SPELLED = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))

_L, _R = r"(?<![A-Za-z0-9_./@+-])", r"(?![A-Za-z0-9_@])"
_DISGUISE = re.compile(r"\s?[\[({<]\s?(at|dot)\s?[\])}>]\s?|(?<=[A-Za-z0-9]) ?(@) ?(?=[A-Za-z0-9-]+(?:\.|\s?[\[(]))", re.I)
# Last parts of a domain by which an address spelled out without brackets is known.
_ENDINGS = "com|org|net|edu|gov|io|info|example|test|invalid|de|fr|es|it|uk|cn|ru|eu"
#: An address spelled out in words: the part before the sign has a dot, a digit, a mark or is followed by a domain of three parts.
_SPELLED_OUT = re.compile(
    rf"(?<![\w.@+-])(?:[A-Za-z0-9_+-]+ dot (?:[A-Za-z0-9_+-]+ dot )*[A-Za-z0-9_+-]+|[A-Za-z]*[0-9_+.-][A-Za-z0-9_+.-]*[A-Za-z0-9]) at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot (?:{_ENDINGS})(?![\w@])", re.I
)
_DIGIT_WORDS = re.compile(r"\b(?:(?:%s)[ -]){3,}(?:%s)\b" % ("|".join(SPELLED), "|".join(SPELLED)), re.I)
#: Cheap signs that the expensive patterns may match; each is implied by a match.
_HINTS = tuple(f"{left}{blank}{word}" for left in "[({<" for blank in ("", " ") for word in ("at", "dot"))
_NUMBERS = re.compile(
    r"[0-9](?:[0-9]{2}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{16}|[0-9]{6,7}-?[A-Za-z]|[0-9] ?[0-9]{2} ?[0-9]{2} ?[A-Da-d](?![A-Za-z0-9])|[0-9LMNP-V][A-Za-z][0-9LMNP-V]{2}[A-Za-z][0-9LMNP-V]{3}[A-Za-z])"
    r"|(?<=[A-Za-z])[L-Vl-v0-9][L-Vl-v0-9][A-Za-z][0-9LMNP-V]{2}[A-Za-z][0-9]"
)
_ROADS = frozenset(
    "street st road rd lane ln avenue ave row crescent terrace drive dr close court ct square sq way boulevard blvd place pl parkway rue allee quai impasse chemin cours route"
    " calle avenida avda av plaza pza paseo camino carrera ronda travesia via viale piazza corso".split()
)
_GERMAN = re.compile(r"(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ring|ufer|damm) ?[0-9]", re.I)
_DIGIT = re.compile(r"[0-9]")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
ID_NUMBER = re.compile(
    _L + r"(?:(?P<ssn>\d{3}([- ])\d{2}\2\d{4})|(?P<cn>\d{17}[\dXx])|(?P<dni>\d{8}-?[A-Z])|(?P<nie>[XYZ]-?\d{7}-?[A-Z])|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<cf>[A-Z]{6}[0-9LMNP-V]{2}[A-EHLMPRST][0-9LMNP-V]{2}[A-Z][0-9LMNP-V]{3}[A-Z]))" + _R + r"(?!-?\d)",
    re.I,
)
PHONE = re.compile(
    _L + r"(?:\+(?:\d[ .-]?|\(\d{1,4}\)[ .-]?){7,14}\d|00[1-9]\d{0,2}(?:[ .-]?\(?\d{2,5}\)?){2,5}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([.-])\d{3}\1\d{4}|[2-9]\d{2} \d{3} \d{4}|0\d{1,5}(?:[ ]\d{2,5}){1,4}|0\d{2,4}[-/]\d{6,8})" + _R + r"(?![-.:/]\d)"
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Crescent|Terrace|Drive|Dr|Close|Court|Ct|Square|Sq|Way|Boulevard|Blvd|Place|Pl|Parkway)"
ADDRESS = re.compile(
    _L + r"(?:(?:[A-Z][a-z]+ \d{4,5}, )?\d{1,5}[A-Za-z]?(?:-\d+)?,? (?:[A-Z][A-Za-z'-]+ ){1,4}" + _STREET + r"\b\.?(?:, (?:Apt|Flat|Unit|Suite|Apartment|No)\.? ?\d+[A-Za-z]?)?(?:, [A-Z][a-z]+(?:-[A-Z][a-z]+)?(?: \d{4,5})?)?"
    r"|(?:\d{5} [A-Z][a-z]+, )?[A-Z][A-Za-zß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm) ?\d{1,4} ?[a-z]?\b(?:, \d{5} [A-Z][A-Za-z-]+)?"
    r"|(?:[0-9]{5} [A-Z][A-Za-z-]+, )?\d{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|allee|quai|impasse|chemin|place|cours|route|square)\b(?: (?:de la|du|des|de|de l'|d'))? ?[A-Z][A-Za-z'-]+(?:, \d{5} [A-Z][A-Za-z-]+)?"
    r"|(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Carrera|Ronda|Travesia|Via|Viale|Piazza|Corso)(?: (?:de la|de los|del|de|la))? ?[A-Z][A-Za-z-]+,? \d{1,4}\b(?:, (?:bajo|\d{1,2}[oa]? ?[A-Z]?\b))?)",
    re.I,
)
#: A count of common things ("12 stale rows", "3 big drive"): an English street has its own name with a capital letter.
_UNNAMED = re.compile(r"\d{1,5}(?:-\d+)? [a-z' -]+$")
ZH_ADDRESS = re.compile(r"[一-鿿]{2,24}?(?:路|街|大道|巷|道|弄)\d+号(?:\d+[栋幢座])?(?:\d+室)?")
_ZH_LEAD = re.compile(r"^.*[到在于往至是址给]|^.*(?:寄往|送到)")
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)?")
_HAN = re.compile(r"[一-鿿]{2,}")


def _plain(c: str) -> str:
    """The plain form of one character, possibly empty or of several characters."""
    if ord(c) in DROPPED:
        return ""
    if c in SPACES:
        return " "
    out = []
    for x in unicodedata.normalize("NFKD", c):
        if not unicodedata.combining(x) and ord(x) not in DROPPED:
            out.append(LOOKALIKES.get(x, HYPHENS.get(x, x)))
    return "".join(out)


class _Plain(dict):
    """Plain forms by code point, for ``str.translate``; ``odd`` has the characters whose form isn't one character."""

    def __init__(self):
        super().__init__()
        self.odd: set[str] = set()

    def __missing__(self, c: int) -> str:
        p = self[c] = chr(c) if 0x20 <= c <= 0x7E else _plain(chr(c))
        if len(p) != 1:
            self.odd.add(chr(c))
        return p


_PLAIN = _Plain()


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters and the place each came from (None: the same place)."""
    if text.isascii() and text.isprintable():
        return text, None
    out = text.translate(_PLAIN)
    if _PLAIN.odd.isdisjoint(text):
        return out, None
    places = []
    for i, c in enumerate(text):
        places.extend([i] * len(_PLAIN[ord(c)]))
    return out, places


def undisguised(text: str, places: list[int] | None) -> tuple[str, list[int] | None]:
    """Disguised at-signs, dots and spelled digits as the characters they stand for, with the places."""
    edits = []
    low = text.lower()
    if "@" in text or any(h in low for h in _HINTS):
        edits = [(m.start(), m.end(), "." if (m[1] or "").lower() == "dot" else "@") for m in _DISGUISE.finditer(text)]
        edits = [e for e in edits if text[e[0] : e[1]] != e[2]]
    if " at " in low and " dot " in low:
        for m in _SPELLED_OUT.finditer(text):
            edits += [(m.start() + x.start(), m.start() + x.end(), "@" if x[1].lower() == "at" else ".") for x in re.finditer(r" (at|dot) ", m[0], re.I)]
    if sum(w in low for w in SPELLED) > 1:
        for m in _DIGIT_WORDS.finditer(text):
            edits.append((m.start(), m.end(), "".join(SPELLED[w] for w in re.split(r"[ -]", m[0].lower()))))
    if not edits:
        return text, places
    source = places if places is not None else range(len(text))
    out, where, at = [], [], 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        out.append(text[at:a]), where.extend(source[at:a])
        out.append(new), where.extend([source[min(a + (text[a] == " " and b - a > 1), len(text) - 1)]] * len(new))
        at = b
    out.append(text[at:]), where.extend(source[at:])
    return "".join(out), where


def valid_id(m: re.Match) -> bool:
    """Whether a number in written form has the right check character, where its form has one."""
    t = re.sub(r"[ -]", "", m[0]).upper()
    if m["cn"]:
        month, day = int(t[10:12]), int(t[12:14])
        weights = [pow(2, 17 - i, 11) for i in range(17)]
        return 1 <= month <= 12 and 1 <= day <= 31 and t[6:8] in ("18", "19", "20") and "10X98765432"[sum(int(c) * w for c, w in zip(t, weights)) % 11] == t[17]
    if m["dni"]:
        return DNI_LETTERS[int(t[:8]) % 23] == t[8]
    if m["nie"]:
        return DNI_LETTERS[int(str("XYZ".index(t[0])) + t[1:8]) % 23] == t[8]
    if m["cf"]:
        total = sum(CODICE_ODD[c] if i % 2 == 0 else (int(c) if c.isdigit() else ord(c) - 65) for i, c in enumerate(t[:15]))
        return chr(65 + total % 26) == t[15]
    return True


def is_phone(number: str) -> bool:
    digits = sum(c.isdigit() for c in number)
    if number[0] == "+" or number.startswith("00"):
        return 8 <= digits <= 16
    return 10 <= digits <= 12


@dataclass
class Names:
    """Known given and family names in lower case, and which of them are also ordinary words."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    ordinary: set[str] = field(default_factory=set)


def _latin_persons(text: str, names: Names) -> list[tuple[int, int]]:
    ws = [(m.start(), m.end(), m[0], m[0].lower()) for m in _WORD.finditer(text)]
    given, family, ordinary = names.given, names.family, names.ordinary
    out: list[tuple[int, int]] = []
    last = -1

    def titled(w: str) -> bool:
        return len(w) > 3 and w[0].isupper() and (w[1:].islower() or w.isupper())

    def gap(i: int) -> str:
        return text[ws[i][1] : ws[i + 1][0]] if 0 <= i < len(ws) - 1 else "\n"

    for i, (start, end, word, low) in enumerate(ws):
        if start < last or not (low in family or low in given):
            continue
        span = None
        if low in family:
            before = ws[i - 1] if i else None
            if before and gap(i - 1) in (" ", ". ", ".") and before[3] in TITLES and (word[0].isupper() or "." in gap(i - 1)):
                span = start, end
            elif before and gap(i - 1) in (". ", ".") and len(before[2]) == 1 and text[before[0] - 1 : before[0]] not in ("'", "’", "-"):
                first = before[0]
                if i > 1 and gap(i - 2) == " " and (ws[i - 2][3] in given or (titled(ws[i - 2][2]) and low not in ordinary and not _opens(text, ws[i - 2][0]))):
                    first = ws[i - 2][0]
                span = first, end
            elif before and gap(i - 1) == " " and before[3] in given:
                if not (low in ordinary and before[3] in ordinary and (word.islower() or not titled(word) and not word.isupper())):
                    span = before[0], end
            elif i < len(ws) - 1 and gap(i) == ", " and ws[i + 1][3] in given and not (low in ordinary and ws[i + 1][3] in ordinary and word.islower()):
                span = start, ws[i + 1][1]
            elif i < len(ws) - 1 and gap(i) == ", " and len(ws[i + 1][2]) == 1 and ws[i + 1][2].isupper() and text[ws[i + 1][1] : ws[i + 1][1] + 1] == ".":
                span = start, ws[i + 1][1]
            elif i < len(ws) - 1 and gap(i) == " " and ws[i + 1][3] in given and ws[i + 1][3] not in ordinary and low not in ordinary and not (i < len(ws) - 2 and gap(i + 1) == " " and ws[i + 2][3] in family):
                span = start, ws[i + 1][1]
            elif low not in ordinary and before and gap(i - 1) == " " and titled(before[2]) and titled(word) and before[3] not in TITLES and not _opens(text, before[0]):
                span = before[0], end
        elif low not in ordinary and i < len(ws) - 1 and titled(word):
            after = ws[i + 1]
            if gap(i) == " " and titled(after[2]) and after[3] not in family and not after[2].isupper():
                span = start, after[1]
            elif gap(i) == " " and len(after[2]) == 1 and after[2].isupper() and gap(i + 1) == ". " and i + 2 < len(ws) and titled(ws[i + 2][2]) and ws[i + 2][3] not in family:
                span = start, ws[i + 2][1]
            elif i and gap(i - 1) == ", " and titled(ws[i - 1][2]) and ws[i - 1][3] not in family and ws[i - 1][0] >= last and i > 1 and gap(i - 2) == " ":
                span = ws[i - 1][0], end
        if span and span[0] >= last:
            out.append(span)
            last = span[1]
    return out


def _opens(text: str, at: int) -> bool:
    """Whether a sentence begins here."""
    return not text[:at].strip() or text[:at].rstrip()[-1] in ".!?:;…\"“(>*-"


def _han_persons(text: str, names: Names) -> list[tuple[int, int]]:
    out = []
    for m in _HAN.finditer(text):
        run, at, i = m[0], m.start(), 0
        while i < len(run) - 1:
            for n in (2, 1):
                if run[i : i + n] in names.family and (size := next((k for k in (2, 1) if len(run[i + n : i + n + k]) == k and run[i + n : i + n + k] in names.given), 0)):
                    out.append((at + i, at + i + n + size))
                    i += n + size - 1
                    break
            i += 1
    return out


def mentions(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention, by places in the text as stored, counted from 0."""
    if not text:
        return []
    flat, places = plain(text)
    flat, places = undisguised(flat, places)
    found: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        nonlocal flat
        found.append((kind, a, b))
        flat = flat[:a] + "\x00" * (b - a) + flat[b:]

    if "@" in flat:
        for m in list(EMAIL.finditer(flat)):
            take("email", m.start(), m.end())
    lows = set(map(str.lower, _WORD.findall(flat)))
    if _DIGIT.search(flat):
        if _NUMBERS.search(flat):
            for m in list(ID_NUMBER.finditer(flat)):
                if valid_id(m):
                    take("id_number", m.start(), m.end())
        for m in list(PHONE.finditer(flat)):
            if is_phone(m[0]):
                take("phone", m.start(), m.end())
        if not lows.isdisjoint(_ROADS) or "C/" in flat or _GERMAN.search(flat):
            for m in list(ADDRESS.finditer(flat)):
                if not _UNNAMED.match(m[0]):
                    take("address", m.start(), m.end())
        if "号" in flat:
            for m in list(ZH_ADDRESS.finditer(flat)):
                lead = _ZH_LEAD.match(m[0])
                take("address", m.start() + (lead.end() if lead else 0), m.end())
    persons = [] if lows.isdisjoint(names.given) and lows.isdisjoint(names.family) else _latin_persons(flat, names)
    if not flat.isascii():
        persons += _han_persons(flat, names)
    for a, b in persons:
        take("person", a, b)
    if places is not None:
        found = [(k, places[a], places[b - 1] + 1) for k, a, b in found]
    return sorted(found, key=lambda f: f[1])


def masked(text: str | None, names: Names) -> str | None:
    """The text with a placeholder such as [EMAIL] for each mention; null stays null."""
    if text is None:
        return None
    for kind, a, b in reversed(mentions(text, names)):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def _evidence(texts: Iterable[str | None], given: set[str], family: set[str]) -> Counter:
    """Counts of (word, role, neighbour) beside known names, and of words overall as (word, "all", "")."""
    out: Counter = Counter()
    seen: Counter = Counter()
    for text in texts:
        if not text:
            continue
        flat, _ = undisguised(*plain(text))
        flat = EMAIL.sub(" \x00 ", flat)
        ws = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(flat)]
        seen.update(w for _, _, w in ws)
        for (_, e, a), (s, _, b) in zip(ws, ws[1:]):
            between = flat[e:s]
            if between == " " and (a in given or b in family):
                out[b, "family", a] += a in given
                out[a, "given", b] += b in family
            elif between == ", " and (a in family or b in given):
                out[a, "family,", b] += b in given
                out[b, "given,", a] += a in family
        for m in _HAN.finditer(flat):
            run = m[0]
            for i in range(len(run) - 1):
                for n in (2, 1):
                    if run[i : i + n] in family and len(x := run[i + n : i + n + 2]) == 2 and len(run) <= i + n + 6:
                        out[x, "han given", run[i : i + n]] += 1
                        break
                if run[i : i + 2] in given and i and not any(run[i - n : i] in family for n in (1, 2) if i >= n):
                    out[run[i - 1], "han family", run[i : i + 2]] += 1
    words = {k[0] for k in out} | given | family
    out.update({(w, "all", ""): n for w, n in seen.items() if w in words})
    return +out


def learned(texts: DataFrame, lexicon: DataFrame, text_col: str = "text") -> Names:
    """The lexicon's names with those that stand beside known ones again and again, in both orders, over all texts.

    The counts are combined in each input partition and summed by a shuffle; the driver gets one row for each word that
    stands beside known names at least ``BESIDE`` times or is in the lexicon.
    """
    rows = lexicon.where("name is not null").select("name", "kind").distinct().collect()
    given = {n.strip().lower() for n, k in rows if k == "given"}
    family = {n.strip().lower() for n, k in rows if k == "family"}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def held() -> pa.RecordBatch:
            w, r, o = zip(*total) if total else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(r, pa.string()), pa.array(o, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "role", "other", "n"])

        for batch in batches:
            total.update(_evidence(batch.column(0).to_pylist(), given, family))
            if len(total) > HELD:
                yield held()
                total.clear()
        yield held()

    counts = texts.select(text_col).mapInArrow(count, "word string, role string, other string, n bigint")
    sums = counts.groupBy("word", "role").agg(F.sum("n").alias("n"), F.countDistinct("other").alias("others"))
    by = sums.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("n", "others")))).alias("stats"))
    strong = F.exists(F.map_values("stats"), lambda x: (x["others"] >= PARTNERS) & (x["n"] >= BESIDE))
    known = F.broadcast(lexicon.where("name is not null").select(F.lower(F.trim("name")).alias("word"), F.lit(True).alias("known")).distinct())
    stats: dict[str, dict] = defaultdict(dict)
    for word, s, _ in by.join(known, "word", "left").where(strong | F.col("known")).collect():
        stats[word] = {k: (v["n"], v["others"]) for k, v in s.items()}
    none = (0, 0)
    names = Names(set(given), set(family))
    for word, s in stats.items():
        for kind, own in (("given", given), ("family", family)):
            side, comma, han = s.get(kind, none), s.get(f"{kind},", none), s.get(f"han {kind}", none)
            usual = s.get("all", none)[0]
            if side[0] >= BESIDE and side[1] >= PARTNERS and len(word) > 2 and (comma[0] > 0 and comma[1] > 0 or side[0] > 0.5 * usual):
                getattr(names, kind).add(word)
            if han[0] >= BESIDE + 2 and han[1] >= BESIDE:
                getattr(names, kind).add(word)
    for word in names.given | names.family:
        s = stats.get(word, {})
        inside = sum(s.get(k, none)[0] for k in ("given", "family", "given,", "family,"))
        if (usual := s.get("all", none)[0]) and inside < ORDINARY * usual:
            names.ordinary.add(word)
    return names


def found(memories: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_pos): one row for each mention of an e-mail address, phone, identity number, address or person;
    ``start_pos`` counts code points of the stored text from 1. Null and empty texts have no mention; a redelivered row
    gives its mentions once."""
    names = learned(memories, lexicon, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(i, k, a + 1) for i, t in enumerate(part.column(1).to_pylist()) for k, a, _ in mentions(t, names)]
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["id", "kind", "start_pos"])

    kind = memories.schema[id_col].dataType.simpleString()
    return memories.select(id_col, text_col).mapInArrow(run, f"id {kind}, kind string, start_pos bigint").distinct()


def redacted(memories: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): every text with typed placeholders for its mentions; null stays null, repeated rows stay repeated."""
    names = learned(memories, lexicon, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([masked(t, names) for t in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = memories.schema[id_col].dataType.simpleString()
    return memories.select(id_col, text_col).mapInArrow(run, f"id {kind}, text string")
