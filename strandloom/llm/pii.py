"""Surrogates for personal data.

Each detected entity is replaced by a keyed surrogate of the same type, format, script
and case.  What identifies an entity, whatever its punctuation (the digits of a number, the
exploded address, the folded spelling), is its canonical form; its characters that may change (letters of a
script's class, digits) spell a number in mixed radix; a keyed permutation P without fixed points,
``P(x) = Q^-1(Q(x) + 1)`` with a Feistel network Q over exactly that number range,
gives another number of the same range, which is spelled in place and laid into the entity's shape.  What stays
(punctuation, top-level domain, country code by its digits, first digit of a card, final letter of a name, which
carries its gender in many languages) tweaks the permutation, and stays the same in the surrogate; so entities of one
type never meet, and equal ones stay equal, across documents, executors and runs with one key, with no table of
entities.  Where a surrogate must keep a property (not to look like a hexadecimal secret, a wrong
check number, a public address), the cycle of P is walked until it has it.  ``collisions`` checks both directions over all
documents; ``checked`` replaces anew under a derived key, should any be found.

The key is the session's setting ``spark.strandloom.pii.key``.  Without it, a random one is drawn for the
application and kept by the driver: surrogates then agree within the application only.

Case does not tell entities apart: the surrogate of an upper-case variant is the
upper-case surrogate.  Card numbers keep whether their check digit holds, IBANs
too, addresses keep being private, loopback or public.

Types: email, phone, ip (v4, v6), card (digits without separators only with a right check digit), secret, ssn, iban,
name (after a title; then everywhere in that text).  A letter or digit that is the only one of its class stays; an entity
in which nothing can change stays and is not counted.  Null texts stay null, empty ones empty; very long texts
are read whole; rows are handled one by one, repeated rows alike; an empty table gives no rows.  The
column of entities takes a name that no other column has.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import staged

SETTING = "spark.strandloom.pii.key"
ROUNDS = 8
ATTEMPTS = 3
TYPES = ("email", "phone", "ip", "card", "secret", "ssn", "iban", "name")

#: Fixed titles that a name follows.
TITLES = "Mr Mrs Ms Miss Mister Sir Madam Dr Doctor Prof Professor Herr Frau Monsieur Madame Mademoiselle Mme Mlle Señor Señora Señorita Don Doña Господин Госпожа".split()
#: Calling codes of one and of two digits; all others have three.
_ONE_DIGIT = "1 7".split()
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
_HEX, _VOWELS, _CONSONANTS = "0123456789abcdef", "aeiou", "bcdfghjklmnpqrstvwxyz"

_PATTERN = re.compile(
    r"""
    (?P<secret>(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)\b["']?\s*[=:]\s*["']?)(?P<value>[^\s"'<>,;]{7,}[^\s"'<>,;.):]|(?=[^\s"'<>,;]*[0-9!@\#$%^&*+=?~])[^\s"'<>,;]{4,}[^\s"'<>,;.):]))
  | (?P<email>[^\W_](?:[\w.+%-]{0,62}[\w+%-])?@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w@]))
  | (?P<iban>\b[A-Z]{2}[0-9]{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b)
  | (?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))
  | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\d]|\.\d)|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])[0-9A-Fa-f]{4}(?=[0-9A-Fa-f:]*::)(?::{1,2}[0-9A-Fa-f]{1,4}){0,6}(?:::)?(?![\w:]))
  | (?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w+])\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))
  | (?P<card>(?<![\w.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![\w-]))
    """,
    re.X,
)
_MAYBE = re.compile(r"[@\d]|::")
_SECRET_WORD = re.compile(r"(?i)key|token|secret|passw")
_NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?[ ]((?:[^\W\d_][\w'’-]*[ ]?){1,3})")


def _number(key: bytes, tweak: bytes, step: int, x: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    seed = hmac.new(key, tweak + step.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8 + 1, "big"), hashlib.sha256).digest()
    return int.from_bytes(hashlib.shake_128(seed).digest(size), "big") % below


def permuted(key: bytes, tweak: bytes, x: int, low: int, high: int) -> int:
    """Another number below low * high: a keyed permutation without fixed points (if low * high > 1)."""
    a, b = divmod(x, high)
    for step in range(0, ROUNDS, 2):
        a = (a + _number(key, tweak, step, b, low)) % low
        b = (b + _number(key, tweak, step + 1, a, high)) % high
    a, b = divmod((a * high + b + 1) % (low * high), high)
    for step in range(ROUNDS - 2, -1, -2):
        b = (b - _number(key, tweak, step + 1, a, high)) % high
        a = (a - _number(key, tweak, step, b, low)) % low
    return a * high + b


def spelled(key: bytes, kind: str, text: str, change: Callable[[int, str], str | None], again: Callable[[str], bool] | None = None) -> str:
    """``text`` with the characters for which ``change(place, lower-case character)`` names an alphabet re-spelled.

    Spellings for which ``again`` holds are passed over.
    """
    source = unicodedata.normalize("NFC", text)
    folded = [c.lower() if len(c.lower()) == 1 else c for c in source]
    alphabets = [change(i, c) for i, c in enumerate(folded)]
    places = [i for i, x in enumerate(alphabets) if x]
    if not places:
        return text
    tweak = "\0".join([kind, "".join(c if not x else "\1" for c, x in zip(folded, alphabets, strict=True)), *dict.fromkeys(x for x in alphabets if x)])
    sizes = [len(alphabets[i]) for i in places]
    x, low, high, half = 0, 1, 1, (len(places) + 1) // 2
    for n, (i, r) in enumerate(zip(places, sizes, strict=True)):
        x = x * r + alphabets[i].index(folded[i])
        low, high = (low * r, high) if n < half else (low, high * r)
    while True:
        x = permuted(key, tweak.encode(), x, low, high)
        out, rest = list(folded), x
        for i, r in zip(reversed(places), reversed(sizes), strict=True):
            rest, digit = divmod(rest, r)
            out[i] = alphabets[i][digit]
        new = "".join(o.upper() if s != f else o for o, s, f in zip(out, source, folded, strict=True))
        if again is None or not again(new):
            return new


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=65_536)
def _any_class(c: str) -> str | None:
    """The alphabet of a lower-case letter or a digit: a listed one, or its neighbours of the same script and category."""
    for x in _CLASSES:
        if c in x:
            return x
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Nd"):
        return None

    def fits(d: str) -> bool:
        return unicodedata.category(d) == kind and _script(d) == _script(c) and d.lower() == d and len(d.upper()) == 1 and d.upper().lower() == d and unicodedata.normalize("NFC", d) == d and not any(d in x for x in _CLASSES)

    return "".join(d for d in map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64)) if fits(d)) if fits(c) else None


def _luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c in _CLASSES[0] else c for c in shape)


def _email(key: bytes, text: str) -> str:
    at = text.index("@")
    labels = text[at + 1 :].lower().split(".")
    fixed = 2 if labels[-2] == "example" else 1  # reserved names stay reserved
    end = len(text) - len(".".join(labels[-fixed:])) - 1
    return spelled(key, "email", text, lambda i, c: _any_class(c) if i < end else None)


def _calling_code(digits: str) -> str:
    return digits[: 1 if digits[:1] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3]


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _phone(key: bytes, text: str) -> str:
    digits = _digits(text)
    code = _calling_code(digits) if text[0] == "+" else ""
    return _refill(text, code + spelled(key, ("phone+" if text[0] == "+" else "phone") + code, digits[len(code) :], lambda i, c: _CLASSES[0]))


def _card(key: bytes, text: str) -> str:
    digits = _digits(text)
    body, off = digits[:-1], (int(digits[-1]) - _luhn(digits[:-1])) % 10
    body = spelled(key, "card", body, lambda i, c: _CLASSES[0] if i else None)
    return _refill(text, body + str((_luhn(body) + off) % 10))


_RANGES = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]


def _ip(key: bytes, text: str) -> str:
    if ":" in text:
        x = int(ipaddress.IPv6Address(text))
        kept, rest = x >> 112, x & ((1 << 112) - 1)  # the first group tells global, local and private addresses
        new = ipaddress.IPv6Address(kept << 112 | permuted(key, f"ip6 {kept}".encode(), rest, 1 << 56, 1 << 56))
        out = new.compressed if "::" in text else new.exploded
        return out.upper() if text != text.lower() else out
    x = int(ipaddress.IPv4Address(text))
    for net in _RANGES:
        if x in range(int(net[0]), int(net[-1]) + 1):
            first, bits = int(net[0]), 32 - net.prefixlen
            return str(ipaddress.IPv4Address(first + permuted(key, str(net).encode(), x - first, 1 << bits // 2, 1 << (bits - bits // 2))))
    while True:  # walk the cycle until the address is public again
        x = permuted(key, b"public", x, 1 << 16, 1 << 16)
        if not any(int(n[0]) <= x <= int(n[-1]) for n in _RANGES):
            return str(ipaddress.IPv4Address(x))


def _is_hex(text: str) -> bool:
    return all(c in _HEX for c in text.lower())


def _secret(key: bytes, text: str) -> str:
    if _is_hex(text):
        return spelled(key, "hex", text, lambda i, c: _HEX)
    return spelled(key, "secret", text, lambda i, c: _any_class(c), again=_is_hex)


def _ssn(key: bytes, text: str) -> str:
    return spelled(key, "ssn", text, lambda i, c: _CLASSES[0] if c in _CLASSES[0] else None)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(key: bytes, text: str) -> str:
    plain = text.replace(" ", "")
    country, given, body = plain[:2], plain[2:4], plain[4:]
    if given == _iban_check(country, body):
        body = spelled(key, "iban" + country, body, lambda i, c: _any_class(c))
        given = _iban_check(country, body)
    else:
        body = spelled(key, "wrong iban" + country + given, body, lambda i, c: _any_class(c), again=lambda b: _iban_check(country, b) == given)
    left = iter(country + given + body)
    return "".join(c if c == " " else next(left) for c in text)


def _name(key: bytes, text: str) -> str:
    last = len(text) - 1

    def change(i: int, c: str) -> str | None:
        if i == last and len(text) > 2:
            return None
        return _VOWELS if c in _VOWELS else _CONSONANTS if c in _CONSONANTS else _any_class(c)

    return spelled(key, "name", text, change)


_MAKERS = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "secret": _secret, "ssn": _ssn, "iban": _iban, "name": _name}


@lru_cache(maxsize=65_536)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The surrogate of an entity of the given type."""
    return _MAKERS[kind](key, text)


def canonical(kind: str, text: str) -> str:
    """What two spellings of the same entity have in common."""
    text = unicodedata.normalize("NFC", text).lower()
    if kind == "phone":
        return ("+" if text[0] == "+" else "") + _digits(text)
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).exploded
    return _digits(text) if kind == "card" else text.replace(" ", "") if kind == "iban" else text


def _is_entity(kind: str, text: str) -> bool:
    """What the pattern can't tell."""
    if kind == "card" and text.isdigit():
        return int(text[-1]) == _luhn(text[:-1])
    if kind == "ip" and ":" in text:
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
    return True


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of each entity in order."""
    found: list[tuple[str, str, str]] = []

    def one(m: re.Match) -> str:
        kind, original = m.lastgroup, m.group(0)
        if m.group("secret"):
            kind, original = "secret", m.group("value")
        if not _is_entity(kind, original):
            return m.group(0)
        new = surrogate(kind, original, key)
        if new == original:
            return m.group(0)
        found.append((kind, original, new))
        return m.group(0)[: -len(original)] + new if kind == "secret" else new

    if _MAYBE.search(text) or _SECRET_WORD.search(text):
        text = _PATTERN.sub(one, text)
    names = set()
    for m in _NAME.finditer(text):
        for w in m[1].split():
            if not w[0].isupper() or len(w) < 2 or w in TITLES:
                break
            names.add(w)
    if names:
        each = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=lambda w: (-len(w), w))) + r")(?!\w)")

        def name(m: re.Match) -> str:
            new = surrogate("name", m[0], key)
            if new != m[0]:
                found.append(("name", m[0], new))
            return new

        text = each.sub(name, text)
    return text, found


_ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("original", T.StringType()), T.StructField("surrogate", T.StringType())])


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or else a random one of the application."""
    given = spark.conf.get(SETTING, None)
    if given:
        return given.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def entities_column(names: list[str]) -> str:
    """A name for the column of entities that none of ``names`` has."""
    out = "_entities"
    while out in {n.lower() for n in names}:
        out = "_" + out
    return out


def surrogates(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced, and at the end a column of entities: (kind, keyed hash of the original, surrogate)."""
    key = key or session_key(docs.sparkSession)
    schema = T.StructType([*[T.StructField(f.name, T.StringType(), True) if f.name == text else f for f in docs.schema], T.StructField(entities_column(docs.columns), T.ArrayType(_ENTITY))])
    names, at = [f.name for f in schema], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, entities = [], []
            for t in batch.column(at):
                t = t.as_py()
                new, found = (t, []) if t is None else replaced(t, key)
                texts.append(new)
                entities.append([{"kind": k, "original": hmac.new(key, canonical(k, o).encode(), hashlib.sha256).hexdigest(), "surrogate": canonical(k, s)} for k, o, s in found])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(entities, kind)], names=names)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)


def collisions(result: DataFrame) -> DataFrame:
    """(kind, what, n): surrogates of more than one original, originals with more than one surrogate; no rows when all is well."""
    every = result.select(F.explode(result.columns[-1]).alias("e")).select("e.*").distinct()
    out = None
    for one, other in (("surrogate", "original"), ("original", "surrogate")):
        part = every.groupBy("kind", F.col(one).alias("what")).agg(F.count_distinct(other).alias("n")).where("n > 1")
        out = part if out is None else out.unionByName(part)
    return out


def checked(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """``surrogates``, written and found free of collisions; on a collision all is replaced anew under a derived key."""
    key = key or session_key(docs.sparkSession)
    for _ in range(ATTEMPTS):
        result = staged(surrogates(docs, text, key), "pii")
        if not collisions(result).limit(1).count():
            return result
        key = hmac.new(key, b"again", hashlib.sha256).digest()
    raise ValueError(f"surrogates collide under {ATTEMPTS} keys")


def counted(result: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the entities found of each type and in all, and the text with surrogates."""
    entities = result.columns[-1]
    of = lambda k: F.size(F.filter(entities, lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return result.select("doc_id", *[of(k) for k in TYPES], F.size(entities).cast("long").alias("n_entities"), F.col(text).alias("text"))
