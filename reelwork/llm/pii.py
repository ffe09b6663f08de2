"""Surrogates for personal data.

Detected entities are replaced by values of the same type and format that depend on a secret key
and the entity alone, so that one entity gets one surrogate in every document without any table.
Numbers, secrets and the parts of addresses go through a keyed permutation of all values of their
format, which leaves none in its place; secrets of over 64 characters go piece by piece, each under the
whole secret. Names (drawn by gender, from letters of their own script), addresses whose top-level
domains fall together, long secrets and those of symbols alone can still collide or stay as they are; a job over
the distinct entities finds these and gives the later entity its next surrogate, a longer one each
time, until all are distinct. A first name is one entity whatever title stands before it; its gender
is that which most of its titles in the whole table tell.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from .common import fresh, small, stage, table

#: For demonstrations and tests only: whoever has the key can link surrogates to entities.
DEMO_KEY = b"reelwork demonstration key"
#: Characters that are permuted together.
PIECE = 64
#: Surrogates that one task draws, about: they are few bytes, but take their time.
DRAWN_PER_TASK = 20_000

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Titles with the gender that they tell (u: neither), and the script of the names that follow.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "u", "Prof": "u", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Señor": "m", "Señora": "f", "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f",
}
FIRST_NAMES = {
    ("latin", "m"): "James John Robert Michael William David Thomas Charles Daniel Matthew Peter Paul Hans Karl Jean Pierre Louis Carlos Juan Miguel Jorge Antonio".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Nancy Emma Anna Laura Julia Ingrid Marie Claire Sophie Carmen Lucia Elena Isabel Maria".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Михаил Павел Андрей Олег Юрий".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се та то".split(),
    "greek": "βα βε βο γα γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε τα το".split(),
}
#: How drawn names end: surnames, and first names by gender.
_ENDINGS = {"latin": ["ton", "ner", "ley", "son", "ert", "in"], "cyrillic": ["нов", "рин", "лев", "сов"], "greek": ["δης", "κης", "του"]}
_GENDERED = {
    "latin": {"m": ["rus", "don", "bert"], "f": ["na", "lia", "rine"], "u": ["ny", "ley"]},
    "cyrillic": {"m": ["мир", "слав", "тин"], "f": ["на", "лия", "рина"], "u": ["ша", "ня"]},
    "greek": {"m": ["νος", "ρης"], "f": ["να", "λια"], "u": ["νι", "λυ"]},
}


def _class(*categories: str) -> str:
    """The characters of the basic plane with these Unicode categories, as the inside of a set."""
    chars = [i for i in range(0x10000) if category(chr(i)) in categories]
    starts = [c for k, c in enumerate(chars) if not k or chars[k - 1] != c - 1]
    ends = [c for k, c in enumerate(chars) if k + 1 == len(chars) or chars[k + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in zip(starts, ends, strict=True))


#: Letters of any script, with the marks that are written after them; those that can begin a name.
_LETTER = f"[{_class('Lu', 'Ll', 'Lt', 'Lm', 'Lo', 'Mn', 'Mc')}]"
_CAPITAL = f"[{_class('Lu', 'Lt', 'Lo')}]"
#: Two letters at least, up to the word's end; an apostrophe may stand inside, but ends before 's.
_NAME = rf"(?:{_CAPITAL}(?:{_LETTER}|['’](?!(?:s|d|m|ll|re|ve)(?!{_LETTER}))(?={_LETTER}))+(?!{_LETTER}))"
#: What may stand before or between names and stays as it is: initials and particles.
_BETWEEN = rf"(?:(?:{_CAPITAL}\.[ -]?|{_CAPITAL}[ -]|(?:van|von|der|den|de|la|le|du|di|da|del|della|dos|bin|al|ten|ter|zu|y)[ -]){{1,4}})?"
#: Kind, what a text must hold for its pattern to be tried, pattern; earlier ones win overlaps.
PATTERNS = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b")),
    ("secret", None, re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))\b[\"']?\s{0,8}[:=]\s{0,8}[\"']?([A-Za-z0-9_+/-]{12,})")),
    ("secret", None, re.compile(r"\b([0-9a-f]{32,})\b")),
    # Key ids keep their public prefix, key blocks their frame.
    ("secret", "IA", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([0-9A-Z]{16})(?![A-Za-z0-9])")),
    ("secret", "PRIVATE KEY", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----\s([A-Za-z0-9+/=:,\s-]{16,}?)-----END [A-Z ]{0,24}PRIVATE KEY-----")),
    ("iban", None, re.compile(r"(?<![\w-])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])")),
    ("ip6", ":", re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:.])")),
    ("ip", ".", re.compile(rf"(?<![0-9.])({_OCTET}(?:\.{_OCTET}){{3}})(?![0-9]|\.[0-9])")),
    ("phone", None, re.compile(r"(?<![\w+])(\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])")),
    ("phone", None, re.compile(r"(?<![\w+])(\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([-.])[0-9]{3}\2[0-9]{4})(?![0-9])")),
    ("phone", None, re.compile(r"(?<![\w+.])(0[1-9](?:[ .][0-9]{2}){4}|0[0-9]{2,4}/ ?[0-9]{5,8})(?![0-9])")),
    ("card", None, re.compile(r"(?<![\w.])([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})(?!\w)")),
    ("ssn", "-", re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])")),
]
_DIGIT = re.compile(r"[0-9]{2}")
_SECRET_WORD = re.compile(r"(?i)token|secret|passw|api[_-]?key|access[_-]?key")
_PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})(\.? ){_BETWEEN}({_NAME}(?:[ -]{_BETWEEN}{_NAME}){{0,2}})")
#: A known first name and what follows it, without a title.
_GENDERS = {n: gender for (_, gender), names in FIRST_NAMES.items() for name in names for n in (name, name.upper())}
_FIRSTS = "".join(sorted({n[0] for n in _GENDERS}))
_RESTS = "|".join(f"(?<={c})(?:{'|'.join(sorted((n[1:] for n in _GENDERS if n[0] == c), key=len, reverse=True))})" for c in _FIRSTS)
# A set comes first, as the search then skips all other characters.
_UNTITLED = re.compile(rf"([{_FIRSTS}](?<!\w[{_FIRSTS}])(?:{_RESTS}))(?:[ -]{_BETWEEN}{_NAME}){{1,2}}")
_WORD = re.compile(rf"(?<!{_LETTER}){_NAME}")

#: Alphabets that a format keeps: a letter is replaced by one of its own alphabet.
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(iban: str) -> int:
    """One for a valid account number without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ip6(value: str) -> str:
    """The usual form of an IPv6 address, empty if it is none (or names none, as ::)."""
    try:
        address = IPv6Address(value)
    except AddressValueError:
        return ""
    return str(address) if int(address) > 1 else ""


#: What a match must fulfil besides its pattern.
_VALID: dict[str, Callable[[str], bool]] = {
    "card": lambda v: _luhn(_digits(v)) == 0,
    "iban": lambda v: _mod97(v.replace(" ", "")) == 1,
    # A group of three places with a digit tells an address from names that are joined by ::.
    "ip6": lambda v: bool(_ip6(v)) and any(len(g) > 2 and _digits(g) for g in v.split(":")),
}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a whole text, in order, without overlaps. For a person
    the span is that of the names after the title, or of a known first name and those after it; its
    kind is 'person:' and the gender. A name of such a person that stands alone anywhere in the text
    is found too; its kind is 'name:' and the kind of that name, where it first stands."""
    digits, secret = _DIGIT.search(text) is not None, None
    spans: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def put(start: int, end: int, kind: str) -> bool:
        at = bisect_right(taken, (start, end))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            return False
        taken.insert(at, (start, end))
        spans.append((start, end, kind))
        return True

    for kind, needs, pattern in PATTERNS:
        if needs and needs not in text:
            continue
        if kind == "secret" and not needs:
            secret = _SECRET_WORD.search(text) is not None if secret is None else secret
            if not (secret or digits):
                continue
        elif kind not in ("email", "secret") and not digits:
            continue
        group = 1 if pattern.groups else 0
        valid = _VALID.get(kind, bool)
        for m in pattern.finditer(text):
            if valid(m[group]):
                put(*m.span(group), kind)
    persons = []
    if any(t in text for t in TITLES):
        for m in _PERSON.finditer(text):
            if put(*m.span(3), kind := f"person:{TITLES[m[1]]}"):
                persons.append((m.start(3), kind, m[3]))
    for m in _UNTITLED.finditer(text):
        if put(*m.span(), kind := f"person:{_GENDERS[m[1]]}"):
            persons.append((m.start(), kind, m[0]))
    if persons:
        known: dict[str, str] = {}
        for _, kind, value in sorted(persons):
            for part, canon, _ in parts(kind, value):
                known.setdefault(canon, part)
        for m in _WORD.finditer(text):
            if part := known.get(m[0].lower()):
                put(*m.span(), f"name:{part}")
    return sorted(spans)


# Keyed permutations


def _round(key: bytes, tweak: bytes, r: int, half: int, bits: int) -> int:
    """As many pseudorandom bits as a half has: blocks of 64 bytes, each with its number."""
    size = (bits + 7) // 8
    data, salt = half.to_bytes(size + 1, "big"), blake2b(tweak, digest_size=16).digest()
    blocks = [blake2b(data, digest_size=min(64, size + 1 - at), key=key[:64], person=bytes([r]) + (at // 64).to_bytes(4, "big"), salt=salt).digest() for at in range(0, size + 1, 64)]
    return int.from_bytes(b"".join(blocks), "big") & ((1 << bits) - 1)


def permute(value: int, n: int, key: bytes, tweak: str) -> int:
    """A permutation of 0 .. n - 1 that depends on the key and the tweak and, if n > 1, maps no
    value to itself: all values in one cycle, in the order of a Feistel network over the next even
    number of bits, which is walked until it is below n."""
    if n < 2:
        return value
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << bits) - 1
    t = tweak.encode()
    while True:
        a, b = value >> bits, value & low
        for r in reversed(range(8)):
            a, b = b ^ _round(key, t, r, a, bits), a
        value = (a << bits) | b
        if value < n:
            break
    value = (value + 1) % n
    while True:
        a, b = value >> bits, value & low
        for r in range(8):
            a, b = b, a ^ _round(key, t, r, b, bits)
        value = (a << bits) | b
        if value < n:
            return value


def reshape(value: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Permutes a string among all strings of its format: each letter or digit stays in its
    alphabet, all else stays as it is. For one key and tweak it is one-to-one among strings of up to
    PIECE characters. Longer ones are permuted piece by piece, each under a tweak of the whole string,
    so that time is linear and pieces that two strings share don't show."""
    if len(value) > PIECE:
        whole = f"{tweak}|{blake2b(value.encode(), key=key[:64], digest_size=16).hexdigest()}"
        n = -(-len(value) // PIECE)
        ends = [len(value) * i // n for i in range(n + 1)]
        return "".join(reshape(value[a:z], key, f"{whole}|{i}", hexadecimal) for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)))
    hexes = "0123456789abcdef"
    sets = [hexes if hexadecimal and c in hexes else _ALPHABET_OF.get(c) for c in value]
    n, rank = 1, 0
    for c, s in zip(value, sets, strict=True):
        if s:
            n, rank = n * len(s), rank * len(s) + s.index(c)
    shape = "".join("." if not s else s[0] for s in sets)
    rank, out = permute(rank, n, key, f"{tweak}|{shape}"), []
    for c, s in zip(reversed(value), reversed(sets), strict=True):
        if s:
            rank, i = divmod(rank, len(s))
            out.append(s[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _like(pattern: str, digits: str) -> str:
    """The digits in the places of the digits of a written form."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in pattern)


# Entities


def _script(name: str) -> str:
    """cyrillic, greek or latin; of any other letter the 128 code points that it stands among."""
    c = name[0]
    if "\u0400" <= c <= "\u052f" or "\u0370" <= c <= "\u03ff":
        return "cyrillic" if c >= "\u0400" else "greek"
    return "latin" if c < "\u0250" or "\u1e00" <= c <= "\u1eff" else f"u{ord(c) & ~127:04x}"


@lru_cache(maxsize=1000)
def _sounds(script: str) -> list[str]:
    """What names of a script are drawn from: syllables, or the letters of a block."""
    if script in _SYLLABLES:
        return _SYLLABLES[script]
    first = int(script[1:], 16)
    letters = [chr(c) for c in range(first, first + 128) if category(chr(c)) in ("Lo", "Ll")]
    return letters if len(letters) > 1 else _SYLLABLES["latin"]


def parts(kind: str, value: str) -> list[tuple[str, str, str | None]]:
    """(kind, canonical form, gender that is told) of what a written entity is replaced by: one, or
    one for each name of a person. Equal kinds and canonical forms are one entity however they are
    written and whatever gender is told."""
    if kind == "email":
        return [("email", value.lower(), None)]
    if kind == "ip":
        return [("ip", ".".join(str(int(x)) for x in value.split(".")), None)]
    if kind == "ip6":
        return [("ip6", _ip6(value), None)]
    if kind == "iban":
        return [("iban", value.replace(" ", ""), None)]
    if kind == "phone":
        country = value[1:].split(" ")[0].split("(")[0].split("-")[0].split(".")[0] if value[0] == "+" else ""
        # Numbers within a country keep what tells that they are.
        country = value[:2] if value[0] == "0" else country if len(country) < 4 else ""
        return [("phone", f"{country}|{_digits(value)[len(country):]}", None)]
    if kind in ("card", "ssn"):
        return [(kind, _digits(value), None)]
    if kind.startswith("person:"):
        names, told = _WORD.findall(value), kind[7:] if kind[7:] != "u" else None
        script = _script(names[0])
        return [(f"first:{script}", n.lower(), told) for n in names[:-1]] + [(f"last:{script}", names[-1].lower(), None)]
    if kind.startswith("name:"):
        return [(kind[5:], value.lower(), None)]
    return [("secret", value, None)]


#: The genders of listed first names, which no title changes.
LISTED = {(f"first:{script}", n.lower()): gender for (script, gender), names in FIRST_NAMES.items() for n in names}


def _spoken(n: int, syllables: list[str], count: int) -> tuple[str, int]:
    """So many syllables by the digits of a number, and what is left of it."""
    out = ""
    for _ in range(count):
        n, i = divmod(n, len(syllables))
        out += syllables[i]
    return out, n


@lru_cache(maxsize=100_000)
def surrogate(kind: str, canon: str, gender: str | None, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate. Each attempt gives another one; of names,
    addresses and secrets it gets longer without bound. gender matters for unlisted first names."""
    tweak = f"{kind}|{attempt}"
    drawn = int.from_bytes(blake2b(f"{tweak}|{canon}".encode(), key=key[:64]).digest(), "big")
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = [reshape(x, key, "domain") for x in domain.split(".")[:-1]]
        suffix = _spoken(drawn, _SYLLABLES["latin"], attempt)[0]
        # A local part stays within its 64 characters.
        return f"{reshape(local, key, tweak)[:max(0, 64 - len(suffix))]}{suffix}@{'.'.join([*labels, 'example'])}"
    if kind == "ip":
        a, b, c, d = map(int, canon.split("."))
        n = permute(((a * 256 + b) * 256 + c) * 256 + d, 1 << 32, key, tweak)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":
        return str(IPv6Address(permute(int(IPv6Address(canon)), 1 << 128, key, tweak)))
    if kind == "iban":
        body = reshape(canon[4:], key, f"{tweak}|{canon[:2]}")
        return f"{canon[:2]}{98 - _mod97(f'{canon[:2]}00{body}'):02d}{body}"
    if kind == "phone":
        country, _, rest = canon.partition("|")
        return f"{country}|{reshape(rest, key, f'{tweak}|{country}')}"
    if kind == "card":
        middle = reshape(canon[1:-1], key, f"{tweak}|{canon[0]}|{_luhn(canon)}")
        last = next(d for d in "0123456789" if _luhn(canon[0] + middle + d) == _luhn(canon))
        return canon[0] + middle + last
    if kind == "ssn":
        return reshape(canon, key, tweak)
    if kind == "secret":
        return reshape(canon, key, tweak, hexadecimal=re.fullmatch("[0-9a-f]+", canon) is not None) + _spoken(drawn, _SYLLABLES["latin"], attempt)[0]
    what, script = kind.split(":")
    listed = LISTED.get((kind, canon))
    if listed and not attempt:
        names = [x.lower() for x in FIRST_NAMES[script, listed]]
        return names[permute(names.index(canon), len(names), key, f"{kind}:{listed}")]
    endings = [""] if script not in _ENDINGS else _ENDINGS[script] if what == "last" else _GENDERED[script][listed or gender or "u"]
    out, n = _spoken(drawn, _sounds(script), 2 + attempt)
    # Russian surnames of women keep their ending.
    tail = "а" if kind == "last:cyrillic" and canon.endswith(("ова", "ева", "ёва", "ина")) else ""
    return out + endings[n % len(endings)] + tail


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new[:1].upper() + new[1:] if like[:1].isupper() else new


def written(kind: str, value: str, news: list[str]) -> str:
    """Surrogates in the written form of what they replace."""
    if kind == "email":
        return news[0].upper() if value.isupper() else news[0]
    if kind == "phone":
        country, _, rest = news[0].partition("|")
        return _like(value, country + rest)
    if kind in ("card", "ssn"):
        return _like(value, news[0])
    if kind == "iban":
        it = iter(news[0])
        return "".join(c if c == " " else next(it) for c in value)
    if kind.startswith("person:"):
        it = iter(news)
        return _WORD.sub(lambda m: _cased(next(it), m[0]), value)
    if kind.startswith("name:"):
        return _cased(news[0], value)
    return news[0]


def replaced(text: str | None, key: bytes, drawn: dict[tuple[str, str], tuple[str | None, int]] | None = None, spans: list[tuple[int, int, str]] | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """A whole text with its entities replaced, and where they were. drawn: gender and attempt of
    entities for which these aren't none and 0; spans: what ``find`` gives for the text."""
    spans = (find(text) if text else []) if spans is None else spans
    if not spans:
        return text, spans
    out, at = [], 0
    for start, end, kind in spans:
        value = text[start:end]
        news = [surrogate(k, c, *(drawn or {}).get((k, c), (None, 0)), key) for k, c, _ in parts(kind, value)]
        out += [text[at:start], written(kind, value, news)]
        at = end
    return "".join([*out, text[at:]]), spans


# Jobs

_SPAN = "array<struct<start:int,end:int,kind:string>>"
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_PART = "array<struct<kind:string,canon:string,gender:string>>"
_PART_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string()), ("gender", pa.string())]))


def detected(docs: DataFrame, spans: str = "_spans", entities: str = "_entities") -> DataFrame:
    """``docs`` with two more columns: the spans of the entities in each text, and their distinct
    parts. Both are empty for null and empty texts. This is the only pass that searches texts."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            found = [(t, find(t)) if t else (t, []) for t in b.column(at).cast(pa.string()).to_pylist()]
            where = [[{"start": s, "end": e, "kind": k} for s, e, k in f] for _, f in found]
            what = [[dict(zip(("kind", "canon", "gender"), p, strict=True)) for p in dict.fromkeys(p for s, e, k in f for p in parts(k, t[s:e]))] for t, f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where, _SPAN_ARROW), pa.array(what, _PART_ARROW)], names=[*names, spans, entities])

    types = docs.sparkSession.createDataFrame([], f"a {_SPAN}, b {_PART}").schema.fields
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, f.dataType) for n, f in zip((spans, entities), types, strict=True))]))


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(4)]
            new = [surrogate(*x, key) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(new, pa.string())], names=["kind", "canon", "gender", "attempt", "new"])

    return rows.select("kind", "canon", "gender", "attempt").mapInArrow(run, "kind string, canon string, gender string, attempt int, new string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, gender, attempt, new) for each distinct entity of ``found`` (kind, canon, gender
    that is told or null): new is its surrogate, and no two entities of a kind share one. Of those
    that would, the one with the lower canonical form keeps it and the others take their next
    attempt, as does an entity whose surrogate would be itself. gender is the one told most often (of
    equals m); null for listed first names, whose own is known.

    It ends for any number of entities: permuted formats never need a second attempt, and all others
    get longer with each. If some were drawn for ever, all that are not would at last be shorter than
    their draws, and then the lowest of them would keep its own."""
    told = lambda g: F.count_if(F.col("gender") == g)
    listed = F.concat_ws("|", "kind", "canon").isin(["|".join(k) for k in LISTED])
    each = found.groupBy("kind", "canon").agg(told("m").alias("m"), told("f").alias("f"))
    gender = F.when(listed | ((F.col("m") == 0) & (F.col("f") == 0)), F.lit(None)).when(F.col("m") >= F.col("f"), "m").otherwise("f")
    each = stage(each.select("kind", "canon", gender.alias("gender"), F.lit(0).alias("attempt")), "found")
    now = stage(_drawn(each.repartition(1 + each.count() // DRAWN_PER_TASK), key), "surrogates")
    while True:
        keeps = F.min(F.when(F.col("canon") != F.col("new"), F.col("canon"))).alias("keeps")
        shared = now.groupBy("kind", "new").agg(F.count("*").alias("n"), keeps).where("n > 1 or keeps is null")
        shared = stage(shared.select("kind", "new", "keeps", F.lit(True).alias("is_shared")), "collisions")
        if small(shared, 0):
            return now
        each = now.join(shared, ["kind", "new"], "left")
        lost = each.where("is_shared and not canon <=> keeps").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt"))
        held = each.where("is_shared is null or canon <=> keeps").select("kind", "canon", "gender", "attempt", "new")
        now = stage(held.unionByName(_drawn(lost, key)), "surrogates")


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with the entities in its texts replaced, and one more
    column at the end: where they were in the old text (_spans, with more underscores before it where
    ``docs`` has that column).

    Texts without entities, empty and null ones stay as they are; a doc_id isn't needed, so null and
    repeated ones change nothing; repeated rows get equal texts; an empty table gives an empty
    result; all other columns pass through. Ties (a name told as often of men as of women) go to m.
    """
    spans, entities, row, own_row, drawn = fresh(docs, "_spans", "_entities", "_row", "_own_row", "_drawn")
    found = stage(detected(docs, spans, entities).withColumn(row, F.monotonically_increasing_id()), "detected")
    each = found.where(F.size(entities) > 0).select(F.col(row).alias("row"), F.explode(entities).alias("e")).select("row", "e.*")
    # Only what the entity alone doesn't tell has to be looked up: each text gets that of its own.
    told = stage(assign(each, key).where("attempt > 0 or gender is not null").select("kind", "canon", "gender", "attempt"), "drawn")
    own = each.select("row", "kind", "canon").distinct().join(told, ["kind", "canon"])
    own = own.groupBy(F.col("row").alias(own_row)).agg(F.collect_list(F.struct("kind", "canon", "gender", "attempt")).alias(drawn))
    some = found.where(F.size(spans) > 0).join(own, F.col(row) == F.col(own_row), "left").select(*docs.columns, spans, drawn)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for b in batches:
            where, looked = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            got = []
            for text, own, known in zip(b.column(at).cast(pa.string()).to_pylist(), where, looked, strict=True):
                known = {(x["kind"], x["canon"]): (x["gender"], x["attempt"]) for x in known or ()}
                got.append(replaced(text, key, known, [(x["start"], x["end"], x["kind"]) for x in own])[0])
            columns = b.columns[: n + 1]
            columns[at] = pa.array(got, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[: n + 1])

    new = some.mapInArrow(run, StructType([f for f in some.schema.fields if f.name != drawn]))
    return new.unionByName(found.where(F.size(spans) == 0).select(*docs.columns, spans))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text pseudonymised and the number of entities replaced."""
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("_spans").alias("n_entities"))
