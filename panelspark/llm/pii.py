"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities (e-mail addresses, phone, card, account and social-security
numbers, IP addresses, secrets, names after a title and later mentions of them)
are replaced by others of the same kind and format: the same length and
character classes, a valid check digit, the same network class, a listed name of
the same gender and script for a listed name, for others one of the same script,
rhythm and last letter. A key makes the replacement; without it there is no way
back. It comes from the setting KEY_SETTING; where that is unset, a random key is
drawn for the application, so nobody can repeat or invert the surrogates.

The surrogate of a value is a keyed permutation of all values of its format,
whatever stands beside the value and in whatever notation it is written. So the
same value always gets the same surrogate, in any document and task
(coreference), different values never share one (distinctness), and none maps to
itself, without any table of entities to join. ``collisions`` checks that on the
entities of the whole table before any text is changed; where it finds a hit,
all surrogates are drawn again under a key derived from the first.

A word behind a title is a name unless it is a title or function word, or, where the
title ends in a full stop that may end a sentence, a word that the text writes small
as well. Later mentions, in capitals too, are replaced unless they are common words
(months, "Long", "Hope") or the text writes them small.

Edge cases: a null text stays null; texts without entities come back unchanged;
long texts are read whole, in time linear in their length; repeated rows get
equal results; an empty table gives an empty result; all other columns are passed
on, whatever their names, and ``n_chars`` follows the text where documents have
it. Names without a title anywhere in the text aren't detected, and later
mentions of a single letter are left alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from secrets import token_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, map_rows, prepare_python, table

#: Setting that holds the key, and how often surrogates are drawn anew for collisions.
KEY_SETTING, TURNS = "spark.panelspark.surrogates.key", 4
ROUNDS = 6
#: Entities that a task holds to tell repeats.
HELD = 100_000
_own_keys: dict[str, bytes] = {}

#: Given names by (script, gender), family names by script; fixed lists to draw from.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Ines Julia Laura Maria Nora Sofia Alice Helen Karin Lucia Marta Paula".split(),
    ("latin", "m"): "Adam Carlos David Felix Hugo Jonas Lukas Martin Oscar Peter Anton Bruno Emil Henri Pablo Simon".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Titles before a name: shortened ones, which may end in a full stop, and whole words.
SHORT_TITLES = "Mr Mrs Ms Dr Prof Sr Sra Srta Mme Mlle".split()
TITLES = (
    "Miss Sir Madam Herr Herrn Frau Monsieur Madame Mademoiselle Señor Señora Señorita Don Doña Господин Госпожа Κύριος Κυρία"
).split()
#: Words that begin sentences or name a time, and family names that are also common
#: words: no name, or one only right behind a title (fixed lists).
FUNCTION_WORDS = frozenset(
    "a an the this that these those he she it we you they i his her its our your their my and or but if when while then there here "
    "what who why how where in on at by for from of to with as no not so yet is are was were do does did has have had can could will "
    "would may might must shall should one two all some any each every both after before since because although however also "
    "der die das ein eine einer und oder aber wenn als er sie es wir ihr ich nicht auch dann im am zum zur mit von für auf bei nach "
    "le la les un une des et ou mais si quand il elle nous vous ils elles je ce cette ces dans sur avec pour par de du au aux "
    "el los las una y o pero cuando ella ellos en con por para del al su sus este esta".split()
)
COMMON_WORDS = FUNCTION_WORDS | frozenset(
    "january february march april may june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday spring summer autumn winter north south east west hope long grace young king rose mark bill art "
    "faith joy lane hill wood woods green brown white black gray bush rice stone field park best rich price page day".split()
)
_NAME = r"[^\W\d_][^\W\d_]*(?:[-'’][^\W\d_]+)*"
PATTERNS: dict[str, re.Pattern] = {
    "email": re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])"),
    "secret": re.compile(
        r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:gh[pousr]_|sk-|xox[bapr]-)[A-Za-z0-9-]{16,}(?!\w)"
        r"|(?i:(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\s*[:=]\s*[\"']?)"
        r"(?P<value>[A-Za-z0-9+/_=.-]{8,})"
    ),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(
        r"(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?![\w-])"
    ),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(
        r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
        r"|(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])"
    ),
    "phone": re.compile(
        r"(?<![\w+.-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1\D)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}(?! ?\d)|(?<!\d )0[1-9](?P<pair>[ .-])(?:\d{2}(?P=pair)){3}\d{2}(?! ?\d)"
        r"|(?i:(?<=phone )|(?<=phone: )|(?<=tel )|(?<=tel\. )|(?<=tel: )|(?<=call )|(?<=fax )|(?<=fax: )|(?<=mobile )|(?<=mobile: ))[2-9]\d{2}[2-9]\d{6})(?![\w-])"
    ),
    "name": re.compile(
        rf"(?<!\w)(?:(?P<short>(?:{'|'.join(SHORT_TITLES)})\.?|M\.)|(?P<title>{'|'.join(TITLES)})) (?P<first>{_NAME})(?: (?P<last>{_NAME}))?"
    ),
}
_DIGIT = re.compile(r"\d")


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or a random one for this application."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    return _own_keys.setdefault(spark.sparkContext.applicationId, token_bytes(32))


@lru_cache(200_000)
def _mix(key: bytes, kind: str, turn: int, value: int, limit: int) -> int:
    size = (limit.bit_length() + 7) // 8 + 8
    said = f"{kind}/{turn}/{value}/{limit}".encode()
    raw = b"".join(hashlib.blake2b(said + bytes([i]), key=key[:64]).digest() for i in range(-(-size // 64)))
    return int.from_bytes(raw[:size], "big") % limit


def permute(key: bytes, kind: str, radices: list[int], digits: list[int]) -> list[int]:
    """A keyed permutation of all digit strings with these radices, without a
    fixed point: a Feistel network, one step ahead, and the network back."""
    if not radices:
        return []
    total = 1
    for r in radices:
        total *= r
    if total == 1:
        return digits
    left = 1
    for r in radices[: len(radices) // 2]:
        left *= r
    right = total // left
    kind = f"{kind}/{','.join(map(str, radices))}"
    value = 0
    for r, d in zip(radices, digits):
        value = value * r + d
    a, b = divmod(value, right)
    for turn in range(ROUNDS):
        a = (a + _mix(key, kind, 2 * turn, b, left)) % left
        b = (b + _mix(key, kind, 2 * turn + 1, a, right)) % right
    value = (a * right + b + 1 + _mix(key, kind, -1, 0, total - 1)) % total
    a, b = divmod(value, right)
    for turn in reversed(range(ROUNDS)):
        b = (b - _mix(key, kind, 2 * turn + 1, a, right)) % right
        a = (a - _mix(key, kind, 2 * turn, b, left)) % left
    value, out = a * right + b, []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


#: Alphabets within which a character stays.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASS_OF = {c: a for a in CLASSES for c in a}


def same_format(key: bytes, kind: str, text: str, alphabets: list[str | None] | None = None) -> str:
    """``text`` with every letter and digit exchanged within its class."""
    alphabets = alphabets or [_CLASS_OF.get(c) for c in text]
    at = [i for i, a in enumerate(alphabets) if a]
    where = "".join("*" if a else c for a, c in zip(alphabets, text))
    new = permute(key, f"{kind}:{where}", [len(alphabets[i]) for i in at], [alphabets[i].index(text[i]) for i in at])
    out = list(text)
    for i, d in zip(at, new):
        out[i] = alphabets[i][d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    doubled = (int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits)))
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def email(key: bytes, text: str) -> str:
    """Case counts in neither part; the top-level domain stays, and so does a
    domain reserved for examples."""
    local, domain = text.split("@")
    host, top = re.fullmatch(r"(?i)(?:(.*?)\.)?(example\.(?:com|net|org)|[^.]+)", domain).groups()
    plain = local if host is None else f"{local}@{host}"
    new = same_format(key, "email." + top.lower(), plain.lower())
    cased = "".join(n.upper() if o.isupper() else n for n, o in zip(new, plain))
    return f"{cased}@{top}" if host is None else f"{cased}.{top}"


def card(key: bytes, text: str) -> str | None:
    """First digit (the brand) and grouping stay, the check digit fits."""
    digits = "".join(_DIGIT.findall(text))
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + "".join(map(str, permute(key, f"card{digits[0]}", [10] * (len(digits) - 2), list(map(int, digits[1:-1])))))
    left = iter(body + str(luhn(body)))
    return _DIGIT.sub(lambda _: next(left), text)


def ip_class(octets: list[int]) -> int:
    a, b = octets[0], octets[1]
    if a == 10:
        return 1
    if a == 172 and 16 <= b < 32:
        return 2
    if a == 192 and b == 168:
        return 3
    return 4 if a in (0, 127) else 5 if a >= 224 else 6 if a == 169 and b == 254 else 0


def ip(key: bytes, text: str) -> str | None:
    """Stays in its class of networks (private, public and so on); of the newer
    addresses the first two groups and the gap stay, and case doesn't tell them apart."""
    if ":" in text:
        at = [m.end() for m in re.finditer(":", text)][1]
        low, hexadecimal = text[at:].lower(), "0123456789abcdef"
        if not any(c != "0" for c in low if c in hexadecimal) or sum(c in hexadecimal for c in low) < 4:
            return None  # nobody's in particular
        new = same_format(key, "ip6" + text[:at].lower(), low, [hexadecimal if c in hexadecimal else None for c in low])
        return text[:at] + (new.upper() if text[at:].isupper() else new)
    octets = list(map(int, text.split(".")))
    fixed = {0: 0, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2}[ip_class(octets)]
    new = octets
    while True:  # walk the permutation until it is back in the class
        new = new[:fixed] + permute(key, f"ip{octets[:fixed]}", [256] * (4 - fixed), new[fixed:])
        if ip_class(new) == ip_class(octets):
            return ".".join(map(str, new))


#: Country calling codes of two digits (fixed values); 1 and 7 have one, all others three.
TWO_DIGITS = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 "
    "91 92 93 94 95 98".split()
)
_NUMBER = re.compile(r"\(0\)|\d")


def phone(key: bytes, text: str) -> str | None:
    """Country code, leading digit's range and punctuation stay; digits alone
    decide, so notations of one number get notations of one number."""
    digits = "".join(m[0] for m in _NUMBER.finditer(text) if len(m[0]) == 1)  # without the trunk prefix (0)
    if not 7 <= len(digits) <= 15:
        return None
    code = 0 if text[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3
    national = digits[code:]
    alphabets: list[str | None] = [CLASSES[0]] * len(national)
    # an area code doesn't begin with 0 or 1 unless it did
    alphabets[0] = "01" if national[0] in "01" else "23456789"
    if digits[:code] in ("", "1") and national[3:6] == "555":  # reserved for fiction, so is the surrogate
        alphabets[3:6] = [None] * 3
    left = iter(digits[:code] + same_format(key, "phone" + digits[:code], national, alphabets))
    return _NUMBER.sub(lambda m: next(left) if len(m[0]) == 1 else m[0], text)


def iban(key: bytes, text: str) -> str | None:
    """Country stays, the check digits fit."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = same_format(key, "iban" + plain[:2], plain[4:])
    new = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    left = iter(new)
    return "".join(c if c == " " else next(left) for c in text)


def issued(ssn: str) -> bool:
    """Whether such a number could have been given to anybody."""
    return ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[4:6] != "00" and ssn[7:] != "0000"


def ssn(key: bytes, text: str) -> str:
    """One that could have been issued stays so."""
    new = same_format(key, "ssn", text)
    while issued(new) != issued(text):  # walk the permutation
        new = same_format(key, "ssn", new)
    return new


def secret(key: bytes, text: str) -> str:
    """Known prefixes stay; hexadecimal strings stay hexadecimal."""
    start = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[bapr]-|", text).end()
    rest = text[start:]
    if re.fullmatch(r"[0-9a-f]+", rest):
        return text[:start] + same_format(key, "hex", rest, ["0123456789abcdef"] * len(rest))
    return text[:start] + same_format(key, "secret" + text[:start], rest)


#: Vowels and consonants of each script, between which a made-up name keeps its rhythm.
SOUNDS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}


_LISTED = {n.lower(): (names, i) for names in GIVEN.values() for i, n in enumerate(names)}


@lru_cache(4096)
def letters_like(c: str) -> str | None:
    """The letters that may stand for a lower-case letter: vowels or consonants
    of its script, or other letters of its kind in its range of 128 characters."""
    for sounds in SOUNDS.values():
        for letters in sounds:
            if c in letters:
                return letters

    def simple(x: str) -> bool:
        return x.isalpha() and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x

    if not simple(c):
        return None
    known = "".join(letters for sounds in SOUNDS.values() for letters in sounds)
    near = map(chr, range(ord(c) // 128 * 128, ord(c) // 128 * 128 + 128))
    kind = unicodedata.category(c)
    return "".join(x for x in near if unicodedata.category(x) == kind and simple(x) and x not in known)


def name_part(key: bytes, word: str) -> str:
    """For a listed given name another of its gender and script. Any other name
    keeps length, rhythm, script and case, and from four letters on its last
    letter, which often tells the gender; it never becomes a listed one."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    if low in _LISTED:
        names, i = _LISTED[low]
        new = names[permute(key, f"given/{names[0]}", [len(names)], [i])[0]]
        return new.upper() if word.isupper() else new
    alphabets = [letters_like(c) for c in low]
    if len(low) > 3 and sum(map(bool, alphabets[:-1])) > 1:
        alphabets[-1] = None
    new = same_format(key, "name", low, alphabets)
    while new in _LISTED:  # walk the permutation until it is off the list
        new = same_format(key, "name", new, alphabets)
    return "".join(n.upper() if o.isupper() else n for n, o in zip(new, word))


SURROGATES: dict[str, Callable[[bytes, str], str | None]] = {
    "email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "ip": ip, "phone": phone,
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ssn": "-"}
_LONG_NUMBER = re.compile(r"\d.{0,3}\d.{0,3}\d")


_TOKEN = re.compile(r"[^\W\d_]\w*")
_ALL_TITLES = frozenset(t.lower() for t in (*SHORT_TITLES, *TITLES))


def is_name(word: str) -> bool:
    """A capitalised word behind a title that isn't a title or a function word;
    months and the like may be names there."""
    low = word.lower()
    return word[0].isupper() and low not in _ALL_TITLES and (low not in FUNCTION_WORDS or low in ("may", "will"))


def entities(text: str, key: bytes) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, surrogate) of all entities; the first kind in
    the order of PATTERNS wins where two overlap."""
    found: list[tuple[int, int, str, str, str]] = []  # in order, apart from each other
    starts: list[int] = []

    def put(start: int, end: int, kind: str, new: str | None) -> None:
        value = text[start:end]
        at = bisect_left(starts, end)
        if new is not None and new != value and (not at or found[at - 1][1] <= start):
            starts.insert(at, start)
            found.insert(at, (start, end, kind, value, new))

    numbers = bool(_LONG_NUMBER.search(text))
    for kind, surrogate in SURROGATES.items():
        if NEEDS.get(kind, "") in text and (numbers or kind in ("email", "secret")):
            for m in PATTERNS[kind].finditer(text):
                start, end = m.span("value") if kind == "secret" and m["value"] else m.span()
                put(start, end, kind, surrogate(key, text[start:end]))
    names: dict[str, str] = {}
    written: set[str] = set()  # words of the text, filled when a name is found
    for m in PATTERNS["name"].finditer(text):
        if not written:
            written.update(x[0] for x in _TOKEN.finditer(text))
        stopped = m["short"] is not None and m["short"][-1] == "."
        for group in ("first", "last"):
            word = m[group]
            # behind a full stop a sentence may begin: no word that the text writes small
            if word is None or not is_name(word) or (group == "first" and stopped and word.lower() in written):
                break
            if len(word) == 1 and group == "last":
                break
            names[word] = names.get(word) or name_part(key, word)
            put(*m.span(group), "name", names[word])
    # later mentions: not of a word that is common, or that the text writes small as well
    later: dict[str, list[str]] = {}  # names by their first letters up to a hyphen or apostrophe
    clear = {w: n for w, n in names.items() if len(w) > 1 and w.lower() not in COMMON_WORDS and w.lower() not in written}
    clear |= {w.upper(): n.upper() for w, n in clear.items() if len(w) > 2 and len(w.upper()) == len(w)}
    for word in sorted(clear, key=len, reverse=True):
        later.setdefault(_TOKEN.match(word)[0], []).append(word)
    for m in _TOKEN.finditer(text) if later else ():  # mentions without a title
        for word in later.get(m[0], ()):
            end = m.start() + len(word)
            free = m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
            if free and text.startswith(word, m.start()) and not text[end : end + 1].isalnum() and text[end : end + 1] != "_":
                put(m.start(), end, "name", clear[word])
                break
    return found


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    found = entities(text, key)
    out, at = [], 0
    for start, end, _, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


def entity_table(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per entity: id, start, kind, value, surrogate."""

    def make():
        return lambda r: [
            (r[id_col], start, kind, value, new) for start, _, kind, value, new in entities(r[text_col] or "", key)
        ]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs, make, [id_col, text_col], f"`{id_col}` {kind}, start long, kind string, value string, surrogate string"
    )


def known_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate), most repeats within a task told already."""

    def make():
        seen: set = set()

        def row(r):
            new = {e[2:] for e in entities(r[text_col] or "", key)} - seen
            if len(seen) > HELD:
                seen.clear()
            seen.update(new)
            return sorted(new)

        return row

    return map_rows(docs, make, [text_col], "kind string, value string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one value of a kind, values with more
    than one surrogate, and values left as they are; empty when distinctness and
    coreference hold. Case doesn't tell addresses and names apart, nor
    punctuation numbers. Combines on the map side."""

    def plain(c: str) -> Column:
        numbers = F.regexp_replace(c, r"\(0\)|[ ().-]", "")
        return F.when(F.col("kind").isin("email", "name"), F.lower(c)).when(F.col("kind").isin("phone", "card", "iban", "ssn"), numbers).otherwise(F.col(c))

    pairs = found.select("kind", plain("value").alias("value"), plain("surrogate").alias("surrogate")).distinct()
    same = F.col("value") == F.col("surrogate")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("value").alias("shared"), same.alias("same")),
        F.struct(F.lit(1).alias("side"), F.col("surrogate").alias("shared"), F.lit(False).alias("same")),
    )
    counts = pairs.select("kind", F.explode(sides).alias("x")).groupBy("kind", "x.side", "x.shared")
    counts = counts.agg(F.count("*").alias("n"), F.max("x.same").alias("same"))
    return counts.filter((F.col("n") > 1) | F.col("same")).select("kind", "shared", "n")


def settled_key(docs: DataFrame, key: bytes, text_col: str = "text") -> bytes:
    """``key``, or the first key derived from it under which the entities of all
    of ``docs`` have no collision."""
    for turn in range(TURNS):
        tried = hashlib.blake2b(str(turn).encode(), key=key[:64]).digest() if turn else key
        if collisions(known_entities(docs, tried, text_col)).isEmpty():
            return tried
    raise ValueError(f"surrogates collide under each of {TURNS} keys")


def replace_entities(docs: DataFrame, key: bytes | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, by the session's key unless one is
    given; ``n_chars`` is counted anew. Reads the texts twice, first to check for collisions; no texts are shuffled."""
    prepare_python(docs.sparkSession)
    at, key = docs.columns.index(text_col), settled_key(docs, key or surrogate_key(docs.sparkSession), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else pseudonymize(t, key)[0] for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, ddl(docs))
    if text_col == "text" and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text with surrogates and how many of each kind it got."""
    kinds = [*SURROGATES, "name"]
    docs = table(spark, sf_dir, "documents")
    key = settled_key(docs, surrogate_key(spark))

    def make():
        def row(r):
            if r["text"] is None:
                return [(r["doc_id"], None, 0, *[0] * len(kinds))]
            text, found = pseudonymize(r["text"], key)
            counts = {k: 0 for k in kinds}
            for e in found:
                counts[e[2]] += 1
            return [(r["doc_id"], text, len(found), *counts.values())]

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_entities long, " + ", ".join(f"n_{k} long" for k in kinds)
    return map_rows(docs, make, ["doc_id", "text"], schema)
