"""Personal data to format-preserving pseudonyms.

Finders propose spans, validators accept them (Luhn, calendar, octets, number plans, IBAN check digits), and each accepted value is
moved by a keyed permutation of its own format: the value becomes an index below the number of values of the format, a Feistel
network over two mixed-radix halves with cycle walking permutes the index, and the index is written back with the same separators
and a correct check digit. Equal values therefore get equal pseudonyms in all documents, different values different ones, lengths stay,
and whoever has the key can undo it. The rounds are keyed BLAKE2b.

Kinds: email, phone, ip (version 4), card, ssn, iban, date, secret (access keys, marked tokens, and values assigned to names such as
password or token). Dates have numbers for the month; names of persons, street addresses and IPv6 addresses are left as they are.

Defined results: null texts stay null, empty ones empty; overlapping finds go to the earlier kind in that order of trust; values
that fail validation stay; repeated rows give repeated rows; a permutation may fix a value (chance one in the number of values of the format);
extra columns are kept by ``pseudonymize_column`` and ignored by ``pseudonyms``.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.llm.common import arrow_rows

#: The session setting that holds the key.
KEY_SETTING = "spark.arborspark.pii.key"
ROUNDS = 10
KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


_session_keys: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of ``spark.arborspark.pii.key``. Where it is unset, a random key that lives as long as the application: values are linked
    within its runs and nobody can undo them. Set a key of your own to link or undo across applications."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def permute(index: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return index
    a = 1
    while a * a < size:
        a <<= 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def f(r: int, half: int) -> int:
        message = f"{tweak}/{size}/{r}/{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=key[:64], digest_size=min(64, width)).digest(), "big")

    while True:
        left, right = divmod(index, b)
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if r % 2:
                right = (right + sign * f(r, left)) % b
            else:
                left = (left + sign * f(r, right)) % a
        index = left * b + right
        if index < size:  # else walk on along the cycle, which returns into the range
            return index


def permute_text(value: str, alphabets: list[str | None], key: bytes, tweak: str, undo: bool = False) -> str:
    """Permute the characters that have an alphabet; the others stay."""
    index, size = 0, 1
    for c, alphabet in zip(value, alphabets):
        if alphabet:
            index = index * len(alphabet) + alphabet.index(c)
            size *= len(alphabet)
    index = permute(index, size, key, tweak, undo)
    out = []
    for c, alphabet in zip(reversed(value), reversed(alphabets)):
        if alphabet:
            index, k = divmod(index, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def _classes(value: str) -> list[str | None]:
    return [next((a for a in (LOWER, UPPER, DIGITS) if c in a), None) for c in value]


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(value: str) -> str:
    return "".join(c for c in value if c in DIGITS)


def _refill(value: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c in DIGITS else c for c in value)


def _email(m: re.Match, key: bytes, undo: bool) -> str | None:
    value = m.group()
    name, _, host = value.rpartition("@")
    stem, dot, top = host.rpartition(".")
    return permute_text(name, _classes(name), key, "email", undo) + "@" + permute_text(stem, _classes(stem), key, "host", undo) + dot + top


#: Names after which a value without digits is a secret behind a colon too; behind others it is prose (fixed values).
TELLING = frozenset("password passwd pwd api_key api-key apikey access_key access-key accesskey".split())


def _secret(m: re.Match, key: bytes, undo: bool) -> str | None:
    value = m.group()
    kind = next(k for k in ("key", "mark", "value") if m.group(k))
    at = m.start(kind) - m.start()
    head, own = value[:at], m.group(kind)
    if kind == "value" and not any(c in DIGITS for c in own) and (len(own) < 8 or m.group("colon") and m.group("name").lower() not in TELLING):
        if not (m.group("eq") and len(own) >= 6):
            return None  # prose after a colon
    hexes = re.fullmatch(r"[0-9a-f]+", own)
    base32 = kind == "key" and re.fullmatch(r"[A-Z2-7]+", own)
    alphabets = [DIGITS + "abcdef"] * len(own) if hexes else [UPPER + "234567"] * len(own) if base32 else _classes(own)
    if kind == "key" and not base32:
        alphabets = [UPPER + DIGITS] * len(own)
    return head + permute_text(own, alphabets, key, "secret", undo) + value[at + len(own) :]


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(m: re.Match, key: bytes, undo: bool) -> str | None:
    value = m.group()
    bare = value.replace(" ", "")
    country, check, rest = bare[:2], bare[2:4], bare[4:]
    if not 11 <= len(rest) <= 30 or _iban_check(country, rest) != check:
        return None
    moved = permute_text(rest, _classes(rest), key, "iban" + country, undo)
    fresh = iter(country + _iban_check(country, moved) + moved)
    return "".join(c if c == " " else next(fresh) for c in value)


def _card(m: re.Match, key: bytes, undo: bool) -> str | None:
    digits = _digits(m.group())
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = permute_text(digits[:-1], ["123456789", *[DIGITS] * (len(digits) - 2)], key, "card", undo)
    return _refill(m.group(), body + str(luhn(body)))


def _phone(m: re.Match, key: bytes, undo: bool) -> str | None:
    value = m.group()
    digits = _digits(value)
    if value.startswith("+") and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            return None
        head = digits[:2]
        return _refill(value, head + permute_text(digits[2:], [DIGITS] * (len(digits) - 2), key, "phone" + head, undo))
    head, own = ("1", digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)
    if len(own) != 10:
        return None
    # area and exchange start with 2 to 9 in a dialable number; other digits are permuted as they are
    lead = [DIGITS[2:] if i in (0, 3) and own[0] in DIGITS[2:] and own[3] in DIGITS[2:] else DIGITS for i in range(10)]
    tweak = "phone1" if lead[0] != DIGITS else "phone1x"
    return _refill(value, head + permute_text(own, lead, key, tweak, undo))


def _ssn(m: re.Match, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(g) for g in m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a = area - 1 - (area > 666)
    index = permute((a * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", undo)
    index, s = divmod(index, 9999)
    a, g = divmod(index, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def _ip(m: re.Match, key: bytes, undo: bool) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    # an octet keeps its number of digits, so lengths stay
    index, size, ranges = 0, 1, []
    for p in parts:
        low, n = {1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)]
        index, size = index * n + int(p) - low, size * n
        ranges.append((low, n))
    index = permute(index, size, key, "ip", undo)
    out = []
    for low, n in reversed(ranges):
        index, k = divmod(index, n)
        out.append(str(low + k))
    return ".".join(reversed(out))


def _date(m: re.Match, key: bytes, undo: bool) -> str | None:
    value = m.group()
    mark = next(c for c in value if c not in DIGITS)
    a, b, c = value.split(mark)
    # a slashed date has one reading by rule, so that its pseudonym is read back the same way
    order = "ymd" if len(a) == 4 else ("dmy" if mark == "." else "mdy")
    if order == "mdy" and int(a) > 12:
        order = "dmy"
    got = dict(zip(order, (a, b, c)))
    bare = len(got["m"]) == 1 or len(got["d"]) == 1  # numbers stand without a leading zero
    if bare and (got["m"][0] == "0" or got["d"][0] == "0"):
        return None
    try:
        day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:
        day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", undo)
        moved = datetime.date.fromordinal(day)
        # walk on until the date is read back the same way: as many digits, and not month first
        if bare and (len(str(moved.month)), len(str(moved.day))) != (len(got["m"]), len(got["d"])):
            continue
        if mark != "/" or order != "dmy" or moved.day > 12:
            break
    two = "" if bare else "02"
    return mark.join({"y": f"{moved.year:04d}", "m": f"{moved.month:{two}d}", "d": f"{moved.day:{two}d}"}[k] for k in order)


#: kind, what a text must hold to be searched, the finder, the validator and permutation.
FINDERS: tuple[tuple[str, Callable[[str], bool], re.Pattern, Callable], ...] = (
    ("email", lambda t: "@" in t, re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"), _email),
    (
        "secret", lambda t: True,
        re.compile(
            r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)(?P<key>[A-Z0-9]{16})(?![A-Za-z0-9])"
            r"|(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza)(?P<mark>[A-Za-z0-9_-]{16,})"
            r"|(?P<name>(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth))\s*(?:(?P<eq>=)|(?P<colon>:))\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{6,}))"
        ), _secret,
    ),
    ("iban", lambda t: True, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", lambda t: True, re.compile(r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9])"), _card),
    (
        "phone", lambda t: True,
        re.compile(r"(?:(?<![0-9])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<![0-9])\+(?!1[ .(-])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![0-9.-])(?:1([ .-]))?[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\2[0-9]{4}|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"),
        _phone,
    ),
    ("ssn", lambda t: "-" in t, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn),
    ("ip", lambda t: "." in t, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _ip),
    (
        "date", lambda t: True,
        re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?!\.?[0-9/-])"), _date,
    ),
)
_ANY_DIGIT = re.compile(r"[0-9]")
_NUMERIC = {"iban", "card", "phone", "ssn", "ip", "date"}


def pseudonymize(text: str | None, key: bytes, undo: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it has."""
    counts: dict[str, int] = {}
    if not text:
        return text, counts
    digits = _ANY_DIGIT.search(text) is not None
    found: list[tuple[int, int, str]] = []
    for kind, may, finder, move in FINDERS:
        if kind in _NUMERIC and not digits or not may(text):
            continue
        mine: list[tuple[int, int, str]] = []
        for m in finder.finditer(text):
            a, b = m.span()
            k = bisect_left(found, (a,))  # finds are in order and apart, so only two can overlap
            if (not k or found[k - 1][1] <= a) and (k == len(found) or b <= found[k][0]) and (fresh := move(m, key, undo)) is not None:
                mine.append((a, b, fresh))
        if mine:
            found = sorted(found + mine)
            counts[kind] = len(mine)
    if not found:
        return text, counts
    out, at = [], 0
    for a, b, fresh in found:
        out += (text[at:a], fresh)
        at = b
    return "".join(out) + text[at:], counts


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count per kind, for every row."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_found", T.LongType())]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    )

    def make():
        def each(row: dict) -> Iterator[tuple]:
            text, counts = pseudonymize(row["text"], key)
            yield row["doc_id"], text, sum(counts.values()), *(counts.get(k, 0) for k in KINDS)

        return each

    return arrow_rows(docs.select("doc_id", "text"), schema, make, out_rows=2_000)


def pseudonymize_column(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``column``; all other columns stay."""

    @F.pandas_udf("string")
    def moved(texts):
        return texts.map(lambda t: pseudonymize(t, key)[0])

    return docs.withColumn(column, moved(F.col(column)))
