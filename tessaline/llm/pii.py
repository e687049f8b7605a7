"""PII pseudonyms by a format-preserving Feistel permutation.

Found values are validated (checksums, octets, calendar) and their characters
are permuted by a keyed Feistel network within the value's format, so equal
values get equal pseudonyms in every document and the key gives them back.

Decimal digits of every script count as digits: a text is searched with its digits
read as 0 to 9, and a pseudonym is written in the script of the digits it replaces.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing

#: Where the key comes from, as hexadecimal digits; Spark redacts settings of such names.
KEY_SETTING = "spark.tessaline.pii.secret"
ROUNDS = 10
DIGITS = "0123456789"
HEX = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Keyed permutation of ``0 .. size-1``: a Feistel network with cycle walking."""
    if size < 2:
        return value
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)

    def f(i: int, x: int, mod: int) -> int:
        digest = hashlib.blake2b(b"%d|%d|%d|" % (i, size, x) + tweak, key=key, digest_size=16).digest()
        return int.from_bytes(digest, "big") % mod

    while True:
        left, right = divmod(value, b)  # left < a, right < b
        steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        for i in steps:
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * f(i, left, b)) % b
            else:
                left = (left + sign * f(i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _spell(value: int, alphabet: str, n: int) -> str:
    out = []
    for _ in range(n):
        value, r = divmod(value, len(alphabet))
        out.append(alphabet[r])
    return "".join(reversed(out))


def _permute(text: str, alphabet: str, key: bytes, tweak: str, back: bool) -> str:
    """Permute texts of one length over ``alphabet``."""
    at = {c: i for i, c in enumerate(alphabet)}
    value = 0
    for c in text:
        value = value * len(alphabet) + at[c]
    return _spell(feistel(value, len(alphabet) ** len(text), key, tweak.encode(), back), alphabet, len(text))


def _refill(shape: str, chars: str, member: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if member(c) else c for c in shape)


def _luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(value: str, key: bytes, kind: str, back: bool) -> str:
    return _refill(value, _permute("".join(c for c in value if c.isdigit()), DIGITS, key, kind, back), str.isdigit)


def _card_passes(value: str) -> bool:
    digits = "".join(c for c in value if c.isdigit())
    return 13 <= len(digits) <= 19 and _luhn_digit(digits[:-1]) == digits[-1]


def card(value: str, key: bytes, back: bool = False) -> str | None:
    """Card numbers of 13 to 19 digits that pass the Luhn check keep passing it."""
    if not _card_passes(value):
        return None
    digits = "".join(c for c in value if c.isdigit())
    body = _permute(digits[:-1], DIGITS, key, "card", back)
    return _refill(value, body + _luhn_digit(body), str.isdigit)


def ip(value: str, key: bytes, back: bool = False) -> str | None:
    """IPv4 addresses with octets up to 255."""
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    n = int.from_bytes(bytes(octets), "big")
    return ".".join(map(str, feistel(n, 1 << 32, key, b"ip", back).to_bytes(4, "big")))


def ssn(value: str, key: bytes, back: bool = False) -> str | None:
    """NNN-NN-NNNN with an area other than 000, 666 and 900 up, no zero group or serial."""
    valid = lambda d: not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")
    digits = value.replace("-", "")
    if not valid(digits):
        return None
    while True:
        digits = _permute(digits, DIGITS, key, "ssn", back)
        if valid(digits):
            return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"


def phone(value: str, key: bytes, back: bool = False) -> str:
    """Phone numbers keep their country code and punctuation."""
    cut = re.match(r"\+[0-9]{1,3}[\s.-]?|1[\s.-]", value)
    head = cut[0] if cut else ""
    return head + _digits(value[len(head) :], key, "phone", back)


def email(value: str, key: bytes, back: bool = False) -> str:
    """Letters become letters and digits digits, in the local part and the domain's name;
    the last label and punctuation stay, and capitals stay where they are, so that an
    address and its capitalised form get pseudonyms that differ in capitals alone."""
    local, domain = value.rsplit("@", 1)
    name, dot, last = domain.rpartition(".")

    def part(text: str, kind: str) -> str:
        lower = text.lower()
        new = _refill(lower, _permute("".join(c for c in lower if c in LETTERS), LETTERS, key, kind + "-letters", back), LETTERS.__contains__)
        new = _refill(new, _permute("".join(c for c in lower if c in DIGITS), DIGITS, key, kind + "-digits", back), DIGITS.__contains__)
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, text))

    return part(local, "mail") + "@" + part(name, "domain") + dot + last


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban_passes(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban(value: str, key: bytes, back: bool = False) -> str | None:
    """IBANs with valid check digits keep their country and get new valid ones."""
    if not _iban_passes(value):
        return None
    plain = value.replace(" ", "")
    country, body = plain[:2], plain[4:]
    body = _refill(body, _permute("".join(c for c in body if c.isdigit()), DIGITS, key, "iban-digits" + country, back), str.isdigit)
    body = _refill(body, _permute("".join(c for c in body if c.isalpha()).lower(), LETTERS, key, "iban-letters" + country, back).upper(), str.isalpha)
    return _refill(value, country + _iban_check(country, body) + body, str.isalnum)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(value: str, key: bytes, back: bool = False) -> str | None:
    """Calendar dates of 1900 to 2099 as YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY or DD/MM/YYYY."""
    sep = re.search(r"[^0-9]", value)[0]
    parts = value.split(sep)
    year_first = len(parts[0]) == 4
    y, m, d = parts if year_first else parts[::-1]
    try:
        n = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= n <= _LAST:
        return None
    new = datetime.date.fromordinal(_FIRST + feistel(n - _FIRST, _LAST - _FIRST + 1, key, b"date", back))
    out = [f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]
    return sep.join(out if year_first else out[::-1])


def secret(value: str, key: bytes, back: bool = False) -> str:
    """Keys and tokens after a word that names them: 32 or more hexadecimal digits."""
    new = _permute(value.lower(), HEX, key, "secret", back)
    return new.upper() if value.upper() == value else new


KINDS: dict[str, Callable] = {"email": email, "iban": iban, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
FOUND = re.compile(
    r"""(?<![\w.%+-])(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})(?![\w-])
    |(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])
    |(?<![A-Za-z])(?i:token|key|secret|passwd|password|apikey)["']?[ ]?[:=][ ]?["']?(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])
    |(?<![\w.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\w|\.[0-9])
    |(?<![\w./-])(?P<date>[0-9]{4}(?P<d1>[-/])[0-9]{2}(?P=d1)[0-9]{2}|[0-9]{2}(?P<d2>[./])[0-9]{2}(?P=d2)[0-9]{4})(?!\w|[./-][0-9])
    |(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    |(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:1[ .-])?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?!\w)
    |(?<!\w)(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?!\w)""",
    re.VERBOSE,
)


#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
        "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_GROUP_END = re.compile(r"[A-Za-z0-9](?![A-Za-z0-9])")
_STRETCH = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)"),
}
_PASSES = {"iban": _iban_passes, "card": _card_passes}
#: How card numbers are usually written.
_USUAL = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")


def _windows(text: str, start: int, kind: str, known: dict) -> list[tuple[bool, int]]:
    """``(usual, end)`` of the valid cards or IBANs at ``start`` that end where a group does.

    Usual ones (an IBAN of its country's length, a card in usual groups) come first,
    then longer ones.
    """
    if (kind, start) not in known:
        found, m = [], _STRETCH[kind].match(text, start)
        for end in [g.end() for g in _GROUP_END.finditer(text, start, m.end())] if m else ():
            value = text[start:end]
            if not value.isascii() or not _PASSES[kind](value):
                continue
            usual = len(value.replace(" ", "")) == IBAN_LENGTHS.get(value[:2]) if kind == "iban" else _USUAL.fullmatch(value) is not None
            found.append((usual, end))
        known[kind, start] = sorted(found, key=lambda x: (not x[0], -x[1]))
    return known[kind, start]


def _best(text: str, m: re.Match, kind: str, key: bytes, back: bool, known: dict) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the best value that starts where ``m`` does.

    A match takes in groups that follow a value, so shorter ones count as well; an
    unusual one gives way to a usual one that starts within it.
    """
    start, end = m.span(kind)
    if kind not in _STRETCH:
        new = KINDS[kind](m[kind], key, back)
        if new is not None:
            return kind, end, new
        kind = "card"  # the one kind that can start where a date, an address or a number failed
    for usual, end in _windows(text, start, kind, known):
        if usual or not any(w[0] for at in range(start + 1, end) for w in _windows(text, at, kind, known)):
            return kind, end, KINDS[kind](text[start:end], key, back)
    return None


#: Decimal digits of all scripts but the first, as 0 to 9; none lies in higher planes.
_READ = {n: str(unicodedata.decimal(chr(n))) for n in range(128, 1 << 17) if unicodedata.category(chr(n)) == "Nd"}
_FOREIGN = re.compile(r"(?![0-9])\d")


def _written(new: str, old: str) -> str:
    """``new`` with its digits in the script of the first digit of ``old``."""
    digit = next((c for c in old if c.isdecimal()), "0")
    if digit.isascii():
        return new
    zero = ord(digit) - unicodedata.decimal(digit)
    return "".join(chr(zero + int(c)) if c in DIGITS else c for c in new)


def replace_text(original: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of each in the new text.

    Where nothing that starts at a match is valid, the search goes on at the next group.
    """
    foreign = not original.isascii() and _FOREIGN.search(original) is not None
    text = original.translate(_READ) if foreign else original
    out, spans, at, length, known = [], [], 0, 0, {}
    m = FOUND.search(text)
    while m:
        kind = next(k for k in KINDS if m[k] is not None)
        start, value = m.start(kind), _best(text, m, kind, key, back, known)
        if value is None:
            m = FOUND.search(text, start + 1)
            continue
        kind, end, new = value
        out += [original[at:start], _written(new, original[start:end]) if foreign else new]
        length += start - at + len(new)
        spans.append((length - len(new), length, kind))
        at = end
        m = FOUND.search(text, at)
    return "".join([*out, original[at:]]), spans


def session_key(spark: SparkSession) -> bytes:
    """The key of ``KEY_SETTING``; where it is unset, a random one for this session.

    Pseudonyms agree between sessions, and can be undone, only where the setting is
    given.
    """
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return bytes.fromhex(spark.conf.get(KEY_SETTING))


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_pii, spans`` for every row.

    ``spans`` (start, end, kind; code points of the new text) tells what was
    replaced.  Values that fail their validation stay, but for valid values within
    them that start and end on group borders, as does every other character.  Null
    texts stay null and empty ones empty, texts of any length are searched whole,
    repeated rows are alike, an empty table gives no rows, and other columns aren't
    read.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = _replace_batch(b.column(1), key)
            n = np.array([len(found.get(i, ())) for i in range(b.num_rows)], np.int32)
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in found[i]] if i in found else None for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(n), pa.array(spans, span)], names=["doc_id", "text", "n_pii", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        releasing(replace), "doc_id long, text string, n_pii int, spans array<struct<start:int,end:int,kind:string>>"
    )


def _replace_batch(texts: pa.Array, key: bytes) -> tuple[pa.Array, dict[int, list]]:
    """The texts with pseudonyms, and the spans of those that changed."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, r"@|\p{Nd}.{0,3}\p{Nd}|[0-9a-fA-F]{32}"), False).to_numpy(zero_copy_only=False)
    new, spans = {}, {}
    for i in np.flatnonzero(maybe).tolist():
        text, found = replace_text(texts[i].as_py(), key)
        if found:
            new[i], spans[i] = text, found
    if new:
        mask = np.zeros(len(texts), bool)
        mask[list(new)] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
    return texts, spans


def pseudonymize_column(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; all rows, columns and other values stay.

    Null texts stay null, repeated rows are alike, and an empty table stays empty.
    """
    names = docs.columns
    at = names.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = _replace_batch(columns[at], key)[0]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(releasing(replace), docs.schema)
