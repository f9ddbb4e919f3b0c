"""Surrogates for personal data: keyed, type-consistent and never shared by two originals.

Entities are found by pattern and checked (octets of an address, check digit of
a card, group numbers of a social-security number). A surrogate is the entity
under a keyed permutation of the values of its own type and shape: digits go to
digits, lower and upper case letters of a script to letters of that case and
script, given names to given names of the same gender and script; separators,
lengths, country prefixes and check digits stay valid. A permutation gives
two different originals two different surrogates and one original the same
surrogate in every document and in every spelling, without any table of what
has been replaced. ``collisions`` checks just that over a whole corpus.

Defined results: a null text stays null, an empty one empty; text outside
entities is unchanged, character by character. Overlapping finds go to the type
listed first. Spellings that differ in case, spaces or separators are one
original. Among fewer than 257 values none stands for itself; among more, one
may by a chance of one in their number. Rows are treated one by one, so repeated rows, ties and null
ids need no care; all columns but ``text`` are passed on as they are.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.store import written

ROUNDS = 8
RING = 256

# Given names by gender and script; surrogates stay inside their list.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Laura Julia Sarah Sophie Claire Camille Alice Elena Carmen Lucia Marta Paula Hannah Lena Katharina Greta Ingrid Mary Linda Susan Karen Nancy Lisa Emily Olivia Charlotte Amelia".split(),
    ("m", "latin"): "James John Robert Michael William David Thomas Daniel Paul Peter Hans Lukas Felix Jonas Stefan Pierre Louis Antoine Hugo Jules Carlos Miguel Pablo Diego Javier Henry George Edward Oliver Samuel".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Σοφία Κατερίνα Άννα Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr": "", "Prof": ""}

DIGITS = "0123456789"
CONSONANTS = "bcdfghjklmnpqrstvwxz"
VOWELS = "aeiouy"
#: Letters that stand for each other; case is kept.
ALPHABETS = [CONSONANTS, VOWELS, "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιουω"]
CLASS_OF = {c: letters for letters in [*ALPHABETS, DIGITS] for c in letters}


def _lower(value: str) -> str:
    """Lower case, but only where upper case leads back."""
    low = value.lower()
    return "".join(l if l == c or l.upper() == c else c for l, c in zip(low, value)) if len(low) == len(value) else value


class Permutation:
    """Keyed permutations of mixed-radix numbers, by a Feistel network over the integers."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, size: int, value: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{size}|{i}|{value}".encode(), "sha256")[:16], "big")

    def number(self, value: int, size: int, tweak: str, allowed: Callable[[int], bool] | None = None) -> int:
        """Where ``value`` goes among ``range(size)``, or among its allowed members.

        Values that leave the range or are not allowed are sent through again
        (cycle walking). Few values are put on a keyed ring and go to the next.
        """
        if size <= RING:
            ring = sorted((n for n in range(size) if allowed is None or allowed(n)), key=lambda n: self._round(tweak, 0, size, n))
            return ring[(ring.index(value) + 1) % len(ring)]
        half = max(1, (size - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        moved = value
        while True:
            left, right = moved >> half, moved & mask
            for i in range(ROUNDS):
                left, right = right, (left ^ self._round(tweak, i, size, right)) & mask
            moved = left << half | right
            if moved < size and (allowed is None or allowed(moved)):
                return moved

    def text(self, value: str, tweak: str, allowed: Callable[[str], bool] | None = None) -> str:
        """Letters and digits replaced inside their classes; anything else stays."""
        spelling, value = value, _lower(value)
        classes = [CLASS_OF.get(c) for c in value]
        size, number = 1, 0
        for c, among in zip(value, classes):
            if among:
                number, size = number * len(among) + among.index(c), size * len(among)
        if size == 1:
            return spelling

        def spelt(n: int) -> str:
            out = []
            for c, among in zip(reversed(value), reversed(classes)):
                if among:
                    n, at = divmod(n, len(among))
                    c = among[at]
                out.append(c)
            return "".join(reversed(out))

        shape = "".join(among[0] if among else c for c, among in zip(value, classes))
        fresh = spelt(self.number(number, size, f"{tweak}|{shape}", allowed and (lambda n: allowed(spelt(n)))))
        return "".join(new.upper() if old.isupper() else new if among else old for new, old, among in zip(fresh, spelling, classes))


@dataclass(frozen=True)
class Kind:
    """A type of entity: how it looks, what it is under any spelling, and its surrogate."""

    name: str
    pattern: str
    valid: Callable[[str], bool]
    canonical: Callable[[str], str]
    surrogate: Callable[[Permutation, str], str]


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _refill(shape: str, digits: str) -> str:
    """The spelling of ``shape`` with other digits."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _card(p: Permutation, value: str) -> str:
    """The issuer digit stays, and so does the check digit's rightness."""
    digits = _digits(value)
    right = luhn(digits)
    return _refill(value, digits[0] + p.text(digits[1:], f"card{digits[0]}{right}", lambda d: luhn(digits[0] + d) == right))


#: Country prefixes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _dialled(value: str) -> tuple[str, str]:
    """Country prefix and the rest of a telephone number; a prefix written without a separator is told by its digits."""
    digits, prefix = _digits(value), re.match(r"\+\d{1,3}(?=[ .\-(])|", value).group()
    if not prefix and value[0] == "+":
        prefix = _COUNTRY.match("+" + digits).group()
    return digits[:len(_digits(prefix))], digits[len(_digits(prefix)):]


def _phone(p: Permutation, value: str) -> str:
    """The country prefix stays, and a leading 0 or 1 stays one of the two."""
    prefix, rest = _dialled(value)
    low = rest[0] in "01"
    return _refill(value, prefix + p.text(rest, f"phone{prefix}{low}", lambda d: (d[0] in "01") == low))


def _ssn_valid(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ssn(p: Permutation, value: str) -> str:
    return _refill(value, p.text(_digits(value), "ssn", lambda d: _ssn_valid(f"{d[:3]}-{d[3:5]}-{d[5:]}")))


#: Address ranges with a meaning of their own.
NETWORKS = [ipaddress.IPv4Network(n) for n in (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")]
_RANGES = [(int(n.network_address), n.num_addresses) for n in NETWORKS]


def _ip(p: Permutation, value: str) -> str:
    """An address stays inside its range, or outside all of them."""
    number = int(ipaddress.IPv4Address(value))
    for start, size in _RANGES:
        if start <= number < start + size:
            return str(ipaddress.IPv4Address(start + p.number(number - start, size, f"ip{start}")))
    return str(ipaddress.IPv4Address(p.number(number, 2**32, "ip", lambda n: not any(start <= n < start + size for start, size in _RANGES))))


def _ip_valid(value: str) -> bool:
    return all(len(part) < 4 and int(part) < 256 and (part == "0" or part[0] != "0") for part in value.split("."))


def _email(p: Permutation, value: str) -> str:
    """Local part and the name of the domain change, the endings of the domain stay."""
    local, domain = value.rsplit("@", 1)
    name, dot, ending = domain.partition(".")
    return f"{p.text(local, 'local' + domain.lower())}@{p.text(name, 'domain' + ending.lower())}{dot}{ending}"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


#: Check digits with the same remainder as those computed.
_OTHER_CHECK = {"02": "99", "97": "00", "98": "01"}


def _iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban(p: Permutation, value: str) -> str:
    plain = value.replace(" ", "")
    if plain[2:4] == (check := _iban_check(plain[:2], plain[4:])):
        rest = p.text(plain[4:], "iban" + plain[:2])
        check = _iban_check(plain[:2], rest)
    else:
        # Valid with other check digits than those computed: stays so.
        rest = p.text(plain[4:], f"iban{plain[:2]}other", lambda r: _iban_check(plain[:2], r) in _OTHER_CHECK)
        check = _OTHER_CHECK[_iban_check(plain[:2], rest)]
    fresh = iter(plain[:2] + check + rest)
    return "".join(c if c == " " else next(fresh) for c in value)


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def _fold(word: str) -> str:
    """A word without case and, in Greek, without accents, which capitals lack."""
    low = _lower(word)
    return unicodedata.normalize("NFC", re.sub("\u0301", "", unicodedata.normalize("NFD", low))).replace("ς", "σ") if _script(low) == "greek" else low


GENDER = {name: key for key, names in GIVEN.items() for name in names}
_LISTED = {_fold(name): name for name in GENDER}
_TITLES = {title.lower() for title in TITLES}
#: Words inside names that stay, except at their end.
PARTICLES = "von van de der den del della di da dos du la le ten ter zu zur vom af av bin ibn al el".split()
JOINERS = ["and", "und", "et"]
_KEPT = {*PARTICLES, *JOINERS}


def _in_capitals(words: Iterable[str]) -> set[str]:
    return {form for w in words for form in (w.upper(), _fold(w).upper())}


# "MS" is more often something else.
_TITLE = "|".join(sorted({*TITLES, *_in_capitals(TITLES)} - {"MS"}, key=lambda w: (-len(w), w)))
_GIVEN = "|".join(sorted({*GENDER, *_in_capitals(GENDER)}, key=lambda w: (-len(w), w)))
_LETTERS = re.compile(r"([^\W\d_]+)")


def _like(word: str, name: str) -> str:
    """A listed name in the case of a word."""
    return name.upper() if word.isupper() and len(word) > 1 else name.lower() if word.islower() else name


def _name(p: Permutation, value: str) -> str:
    """Titles and particles stay; given names go to given names of their list, other words to other words of the same shape.

    Each word goes by its fold alone, inside ranges that do not meet, so that
    different names stay different and one name is one in any case.
    """
    parts = _LETTERS.split(value)
    last = len(parts) - 2
    for i in range(1, len(parts), 2):
        word = parts[i]
        fold = _fold(word)
        if fold in _TITLES or fold in _KEPT and i < last:
            continue
        if listed := _LISTED.get(fold):
            names = GIVEN[GENDER[listed]]
            parts[i] = _like(word, names[p.number(names.index(listed), len(names), f"given{GENDER[listed]}")])
        else:
            taken = _TITLES if i == last else _TITLES | _KEPT
            parts[i] = p.text(word, "name", lambda w: (f := _fold(w)) not in _LISTED and f not in taken)
    return "".join(parts)


def _canonical_name(value: str) -> str:
    parts = _LETTERS.split(" ".join(value.split()))
    parts[1::2] = [_lower(_LISTED.get(_fold(w), w)) for w in parts[1::2]]
    return "".join(parts)


def _token(p: Permutation, value: str) -> str:
    """Hexadecimal secrets stay hexadecimal."""
    size = 16 ** len(value)
    return f"{p.number(int(value, 16), size, f'hex{len(value)}'):0{len(value)}x}"


_WORD = r"[^\W\d_]"
_LOCAL = r"\d{3,4}[ .\-]?\d{3,4}"
#: ``+`` or brackets tell a number from what stands beside it, and so do two equal
#: hyphens or dots from a space; only other digit groups may be part of a longer one.
_PHONE = (
    rf"(?<![\w+])(?:\+\d{{1,3}}[ .\-]?(?:\(\d{{2,4}}\)[ .\-]?|\d{{2,4}}[ .\-]){_LOCAL}(?!\w)|\+\d{{1,3}}[ .\-]\d{{6,14}}(?!\w)|\+\d{{8,15}}(?!\w)"
    rf"|\(\d{{2,4}}\)[ .\-]?{_LOCAL}(?!\w)|(?<!\d[.\-])(?:\d{{3}}-\d{{3,4}}-\d{{4}}|\d{{3}}\.\d{{3,4}}\.\d{{4}})(?!\w|[.\-]\d)"
    rf"|(?<!\d[ .\-])\d{{2,4}}[ .\-]{_LOCAL}(?!\w|[ .\-]\d))")
_CAPITAL = "[" + "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper()) + "]"
_CAPITALISED = rf"(?:{_CAPITAL}['’])?{_CAPITAL}{_WORD}+(?:['’\-]{_CAPITAL}{_WORD}+)*(?!\w)"
#: White space inside a name, with one line break at most.
_SPACE = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
_TITLED = rf"(?:{_TITLE})(?!\w)\.?"
_NEXT = rf"(?:{_SPACE}(?:{'|'.join(PARTICLES)})(?!\w)){{0,3}}{_SPACE}(?:{_CAPITALISED}|{_CAPITAL}\.)"
#: All titles and the whole run of capitalised words and initials, or a given name and that run.
_FULL_NAME = (
    rf"\b(?:{_TITLED}(?:{_SPACE}(?:(?:{'|'.join(JOINERS)}|&){_SPACE})?{_TITLED})*(?:{_SPACE}{_WORD}+)??(?:{_NEXT})+"
    rf"|(?:{_GIVEN})(?!\w)(?:-{_CAPITAL}{_WORD}+)*(?:{_NEXT})+)")
#: In order of precedence where finds overlap.
KINDS = [
    Kind("email", r"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", lambda v: True, str.lower, _email),
    Kind("secret", r"(?<![\w])AKIA[A-Z0-9]{16}(?!\w)", lambda v: True, str, lambda p, v: "AKIA" + p.text(v[4:], "access")),
    Kind("password", r"(?<=password=)[^\s\"']+", lambda v: True, str, lambda p, v: p.text(v, "password")),
    Kind("token", r"(?<![\w])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}(?!\w)", lambda v: True, str, _token),
    Kind("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban_valid, lambda v: v.replace(" ", ""), _iban),
    Kind("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", _ssn_valid, _digits, _ssn),
    Kind("card", r"(?<![\w\-.])[3-6]\d{3}(?:\d{9,12}|(?:[ \-]\d{4}){3}|[ \-]\d{6}[ \-]\d{5})(?![\w\-])", lambda v: luhn(_digits(v)), _digits, _card),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip_valid, str, _ip),
    Kind("phone", _PHONE, lambda v: 9 - (v[0] == "+") <= len(_digits(v)) <= 15, lambda v: "-".join(_dialled(v)), _phone),
    # Last, and searched for apart from the others.
    Kind("name", _FULL_NAME, lambda v: True, _canonical_name, _name),
]
_BY_NAME = {kind.name: kind for kind in KINDS}
_COMPILED = {kind.name: re.compile(kind.pattern) for kind in KINDS}
_ANY = re.compile("|".join(f"(?P<{kind.name}>{kind.pattern})" for kind in KINDS if kind.name != "name"))
#: Every entity but names holds one of these; the stretch between two of one entity is shorter than GAP.
_ANCHOR = re.compile(r"[0-9@]|AKIA|password=")
GAP = 16
#: For a first pass over whole columns: no entity without a match.
HINT = rf"[0-9@]|AKIA|password=|{_TITLE}|{_GIVEN}"
_NAME_HINT = re.compile(f"{_TITLE}|{_GIVEN}")


_BLANK = re.compile(r"\s")


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where anchors lie, with what surrounds them up to white space beyond the gap; no two meet.

    An entity may reach from one anchor to the next, but not over white space at
    the rim of a stretch. Each character is looked at once from either side.
    """
    begin, end = 0, -1
    for anchor in _ANCHOR.finditer(text):
        if anchor.end() + GAP <= end:
            continue
        low = max(0, anchor.start() - GAP)
        while low > end and low > 0 and not text[low - 1].isspace():
            low -= 1
        if low > end:
            if end >= 0:
                yield begin, end
            begin = low
        rim = _BLANK.search(text, min(len(text), anchor.end() + GAP))
        end = rim.start() if rim else len(text)
    if end >= 0:
        yield begin, end


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """``type, value, start, end`` of the entities of a text, in order."""
    out = []
    for at, end in _stretches(text):
        while at < end and (found := _ANY.search(text, at, end)):
            first = KINDS.index(_BY_NAME[found.lastgroup])
            for kind in KINDS[first:-1]:
                # A type whose check fails leaves the place to those after it.
                again = found if kind.name == found.lastgroup else _COMPILED[kind.name].match(text, found.start(), end)
                if again and kind.valid(again.group()):
                    out.append((kind.name, again.group(), again.start(), again.end()))
                    at = again.end()
                    break
            else:
                at = found.start() + 1
    if _NAME_HINT.search(text):
        # Names lie between other entities, and end where one begins.
        free = zip([0, *(end for *_, end in out)], [*(start for *_, start, _ in out), len(text)])
        out += [("name", n.group(), n.start(), n.end()) for begin, end in free for n in _COMPILED["name"].finditer(text, begin, end)]
        out.sort(key=lambda found: found[2])
    return out


def pseudonymised(text: str, permutation: Permutation, again: dict[tuple[str, str], Permutation] = {}) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and ``type, canonical original, canonical surrogate`` of each.

    ``again`` has permutations of their own for some originals.
    """
    out, at, replaced = [], 0, []
    for name, value, start, end in entities(text):
        kind = _BY_NAME[name]
        original = kind.canonical(value)
        fresh = kind.surrogate(again.get((name, original), permutation), value)
        out += [text[at:start], fresh]
        replaced.append((name, original, kind.canonical(fresh)))
        at = end
    return "".join(out) + text[at:], replaced


_FIELDS = ("type", "original", "surrogate")
REPLACED = pa.list_(pa.struct([(name, pa.string()) for name in _FIELDS]))
REPLACED_TYPE = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in _FIELDS]))


#: Column with the retries of a row's entities, while some are settled.
RETRIES = "retries of surrogates"
RETRIES_TYPE = "array<struct<type: string, original: string, turn: int>>"
#: Turns after which an original that still meets another is an error; chance alone does not get there.
TURNS = 32


def replace(documents: DataFrame, key: bytes, record: bool = False, keyed: Callable[[bytes], Permutation] = Permutation) -> DataFrame:
    """The documents with surrogates in ``text``; with ``record``, also a column ``replaced``.

    Originals in a column ``RETRIES`` get their surrogates by a key of that turn.
    """
    permutation, retried = keyed(key), RETRIES in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, Permutation] = {}

        def again(found: list[dict] | None) -> dict[tuple[str, str], Permutation]:
            for r in found or []:
                if r["turn"] not in turns:
                    turns[r["turn"]] = keyed(key + f"|{r['turn']}".encode())
            return {(r["type"], r["original"]): turns[r["turn"]] for r in found or []}

        for batch in batches:
            texts = batch.column("text")
            likely = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()
            retries = batch.column(RETRIES).to_pylist() if retried else [None] * len(batch)
            batch = batch.drop_columns([RETRIES]) if retried else batch
            if not any(likely) and not record:
                yield batch
                continue
            done = [pseudonymised(t, permutation, again(r)) if maybe else (t, []) for t, maybe, r in zip(texts.to_pylist(), likely, retries)]
            at = batch.schema.get_field_index("text")
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            names = list(batch.schema.names)
            if record:
                columns.append(pa.array([[dict(zip(_FIELDS, r)) for r in found] for _, found in done], REPLACED))
                names.append("replaced")
            yield pa.RecordBatch.from_arrays(columns, names)

    documents = documents.drop("replaced") if record else documents
    others = documents.drop(RETRIES).schema
    schema = T.StructType([*others, T.StructField("replaced", REPLACED_TYPE)]) if record else others
    return documents.mapInArrow(run, schema)


def replace_checked(documents: DataFrame, key: bytes, record: bool = False, keyed: Callable[[bytes], Permutation] = Permutation) -> DataFrame:
    """``replace`` after a check of all entities of ``documents``; originals that would meet are settled first."""
    if collisions(replace(documents.select("text"), key, record=True, keyed=keyed)).isEmpty():
        return replace(documents, key, record, keyed)
    return replace(_settled(documents, key, keyed), key, record, keyed)


def _settled(documents: DataFrame, key: bytes, keyed: Callable[[bytes], Permutation]) -> DataFrame:
    """The documents with a column ``RETRIES``.

    Of originals with one surrogate the smallest keeps it, the others get one of
    the next turn, until no two meet. Turns are a table joined to the rows whose
    texts hold these originals; all other rows have none.
    """
    # Whole rows as one column, so that no name of theirs can clash.
    rows = written(documents.select(F.monotonically_increasing_id().alias("n"), "text", F.struct("*").alias("row")), "unsettled")
    held = written(replace(rows.select("n", "text"), key, record=True, keyed=keyed).select(
        "n", F.explode(F.array_distinct(F.transform("replaced", lambda r: F.struct(r["type"].alias("type"), r["original"].alias("original"))))).alias("r")).select("n", "r.*"), "entities")
    turns = None
    for turn in range(1, TURNS + 1):
        of_row = rows.select("n", "text") if turns is None else rows.select("n", "text").join(_of_rows(held, turns), "n", "left").drop("n")
        pairs = written(replace(of_row, key, record=True, keyed=keyed).select(F.explode("replaced").alias("r")).select("r.*").distinct(), "pairs")
        meet = pairs.groupBy("type", "surrogate").agg(F.min("original").alias("least"), F.count("*").alias("n")).where("n > 1")
        late = pairs.join(meet, ["type", "surrogate"]).where("original <> least").select("type", "original").distinct().withColumn("turn", F.lit(turn))
        late = written(late, "turns")
        if late.isEmpty():
            break
        turns = late if turns is None else written(turns.union(late).groupBy("type", "original").agg(F.max("turn").alias("turn")), "turns")
    else:
        raise ValueError(f"surrogates of {late.count()} originals still meet others after {TURNS} turns")
    if turns is None:
        return documents
    return rows.join(_of_rows(held, turns), "n", "left").select("row.*", RETRIES)


def _of_rows(held: DataFrame, turns: DataFrame) -> DataFrame:
    """For rows that hold some of the originals in ``turns``, these as a list."""
    return held.join(turns, ["type", "original"]).groupBy("n").agg(F.collect_list(F.struct("type", "original", "turn")).cast(RETRIES_TYPE).alias(RETRIES))


def collisions(replaced: DataFrame) -> DataFrame:
    """``type, surrogate`` that stand for several originals, or originals with several surrogates.

    ``replaced`` is the result of ``replace(..., record=True)``; an empty answer
    means that distinctness and coreference hold over all its rows.
    """
    pairs = replaced.select(F.explode("replaced").alias("r")).select("r.*").distinct()
    shared = pairs.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), F.lit("shared surrogate").alias("fault"))
    split = pairs.groupBy("type", "original").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("original").alias("value"), F.lit("several surrogates").alias("fault"))
    return shared.union(split)
