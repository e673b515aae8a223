"""Surrogates for personal data.

Entities are found by pattern and check digits, and replaced by keyed
surrogates of the same type, script and format: a permutation of all values of
that format (a Feistel network walked along its cycle until it lands in the
format), so distinct values stay distinct and one value has one surrogate in
every document, without any table of what was seen.
"""

from __future__ import annotations

import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b, shake_256
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 8
#: Characters that one permutation takes; longer values are permuted block by block, to and fro, so that all depends on all.
BLOCK_CHARS = 48
# Given names by gender, and titles by gender (None: either), as they are written. A surrogate is of the same gender and script.
GIVEN = {
    "f": (
        "Aisha Alice Amina Ana Anna Camille Carmen Charlotte Chloe Clara Claire Elena Elizabeth Emily Emma Eva Fatima Hannah Helga Ingrid Isabel Jane Jennifer Julia Karen Laura Leila Linda "
        "Lucia Maria Marie Martha Mary Mei Monika Nicole Olga Olivia Patricia Priya Sabine Sarah Sofia Sophie Susan Svetlana Ursula Yuki Zeynep "
        "Анна Мария Елена Ольга Татьяна Наталья Светлана Ирина Μαρία Ελένη Σοφία Αικατερίνη"
    ).split(),
    "m": (
        "Ahmed Andreas Antonio Arjun Carlos Charles Daniel David Diego Dmitri Ernst Francisco Friedrich George Hans Hassan Henri Hiroshi Ivan Jacques James Javier Jean John Jose Juan Jürgen "
        "Karl Klaus Kwame Louis Luis Manuel Mark Mehmet Michael Miguel Mohammed Omar Paul Pedro Peter Philippe Pierre Richard Robert Sergei Stefan Thomas Wei William Wolfgang "
        "Иван Пётр Александр Дмитрий Сергей Андрей Алексей Михаил Γιώργος Γιάννης Νίκος Δημήτρης"
    ).split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Señorita Sra Srta госпожа г-жа κυρία السيدة".split(),
    "m": "Mr Herr Monsieur Señor Sr господин г-н κύριος السيد".split(),
    None: "Dr Prof".split(),
}
# What follows a title without being a name.
OFFICES = frozenset("ambassador chair chairman chairwoman chancellor commissioner judge justice mayor minister moderator officer president prime professor secretary speaker".split())
# Country calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Openings of payment card numbers and their lengths.
CARDS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|6(?:011|5\d\d|4[4-9]\d|2\d\d)\d{12,15}")
# Alphabets of a script whose letters are exchanged among each other.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâãéèêíìîóòôõúùûäöü", "çñßšžðþłćńśźżčďěňřťů", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъьіїєґ"]
_RANGES = [(0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0904, 0x0939)]
# Address ranges (first bits, number of them) whose members stay inside them.
IP_RANGES = [(0x00, 8), (0x0A, 8), (0x7F, 8), (0x64 << 2 | 1, 10), (0xA9FE, 16), (0xAC1, 12), (0xC0A8, 16), (0xE, 4), (0xF, 4)]
#: Consonants and vowels of the syllables that surrogate surnames are made of.
_SYLLABLES = [c + v for c in "bdfghjklmnprstvwyz" + "c" + "x" for v in "aeiou"]
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}

_TITLE_GENDER = {x: g for g, ts in TITLES.items() for t in ts for x in (t, t.upper(), t.capitalize())}
_GIVEN_GENDER = {n.lower(): g for g, ns in GIVEN.items() for n in ns}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_NAMES = re.compile(rf"\.?[ \t]+({_NAME}(?:[ \t]+{_NAME}){{0,2}})")
_SURNAME = re.compile(rf"[ \t]+({_NAME})")
_WORD = re.compile(_NAME)
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]|-+[^\W_]))*"
NUMBERS = re.compile(
    rf"(?P<email>(?<![\w.+-])[\w.+-]+@{_LABEL}(?:\.{_LABEL})+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})(?![\w-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<local>(?<![\w.,+-])(?:\d{3,5}(?:[ ]\d{3,6}){1,3}|\d{9,12})(?![\w-]|[.,]\d))"
)
#: What stands before a number that is a telephone's though it has no such format, and before a secret without a sign of assignment.
_PHONE_CUE = re.compile(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|contact)\b[^\n]{0,16}\Z")
_SECRET_CUE = re.compile(r"(?i)(?:secret|token|key|credential|passw|auth)[^\n]{0,24}\Z")
_ENTROPY = re.compile(r"(?<![\w/+=.-])[A-Za-z0-9/+_-]{32,}={0,2}(?![\w/+=-])")
SECRETS = re.compile(
    r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)\b[\"']?\s{0,20}(?P<sign>[:=])\s{0,20}"
    r"(?:\"(?P<a>[^\"\s]{6,})\"|'(?P<b>[^'\s]{6,})'|(?P<c>[^\s\"',;]{6,}))|-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?P<pem>(?s:.{16,}?))(?=-----END|\Z)"
)
_VERSION = re.compile(r"(?i)(?:\bv|\bver|version|release|build)[.:]?\s{0,3}\Z")
#: The end of what stands before a sentence.
_SENTENCE = re.compile(r"(?:\A|[.!?:\n])[\s\"'“”«»(\[]*\Z")
#: A word just before and just after a place.
_WORD_END, _WORD_START = re.compile(r"[^\W_][ \t]*\Z"), re.compile(r"[ \t]*[^\W_]")
_NUMERIC_START = re.compile(r"[@\d]")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    surrogate: str


def ascii_digits(value: str) -> str:
    """The decimal digits of a value, of any script, as 0-9."""
    return "".join(str(unicodedata.decimal(c)) for c in value if c.isdecimal())


def refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order, each by one of its own script."""
    it = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(it))) if c.isdecimal() else c for c in shape)


def phone_parts(value: str) -> tuple[str, str]:
    """Country code (empty without a plus sign) and the other digits, whatever the format."""
    digits = ascii_digits(value)
    if not value.startswith("+"):
        return "", digits
    n = 1 if digits[0] in "17" else 2 if digits[:2] in CALLING_CODES else 3
    return digits[:n], digits[n:]


def canonical(kind: str, value: str) -> str:
    """One text for all formats of a value; equal for two values exactly if they are the same one."""
    if kind == "phone":
        return "+".join(phone_parts(value))
    if kind in ("card", "ssn"):
        return ascii_digits(value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value.lower() if kind in ("email", "name", "given") else value


class Surrogates:
    """Keyed replacements. All methods map distinct values of a type to distinct values of it."""

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key, digest_size=32).digest()
        self._cached = lru_cache(maxsize=1 << 16)(self._replace)
        # a known given name's surrogate is the next one of its gender and script in an order of the key
        self._next: dict[tuple[str, str], str] = {}
        for gender, names in GIVEN.items():
            for script in {unicodedata.name(n[0])[:5] for n in names}:
                ring = sorted((n for n in names if unicodedata.name(n[0])[:5] == script), key=lambda n: blake2b(n.encode(), key=self.key).digest())
                self._next |= {(gender, n.lower()): ring[(i + 1) % len(ring)] for i, n in enumerate(ring)}

    def replace(self, kind: str, value: str) -> str:
        return self._cached(kind, value) if len(value) <= 128 else self._replace(kind, value)

    def permuted(self, x: int, size: int, tweak: bytes) -> int:
        """A permutation of 0 .. size - 1: Feistel over the next power of four, walked until it is below ``size``."""
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        head = self.key + size.to_bytes((size.bit_length() + 7) // 8, "big") + tweak
        while True:
            left, right = x >> half, x & mask
            for r in range(ROUNDS):
                # both halves are changed in all their bits: the digest is as wide as a half
                data = head + bytes([r]) + right.to_bytes(width, "big")
                f = blake2b(data, key=self.key, digest_size=width).digest() if width <= 64 else shake_256(data).digest(width)
                left, right = right, left ^ (int.from_bytes(f, "big") & mask)
            x = left << half | right
            if x < size:
                return x

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self.permuted(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}".encode())).zfill(len(digits)) if digits else ""

    def _indices(self, at: list[int], sizes: list[int], tweak: bytes) -> list[int]:
        """A permutation of mixed-radix numbers."""
        x, size = 0, 1
        for i, n in zip(at, sizes):
            x, size = x * n + i, size * n
        x = self.permuted(x, size, tweak)
        out = []
        for n in reversed(sizes):
            x, i = divmod(x, n)
            out.append(i)
        return out[::-1]

    def letters(self, text: str, tweak: str) -> str:
        """Every letter and digit exchanged within its alphabet, as one permutation of all texts of this shape; case and other characters stay."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        places: list[tuple[str | tuple[int, int], int, int]] = []
        for c in low:
            if c in _PLACE:
                alphabet, i = _PLACE[c]
                places.append((alphabet, i, len(alphabet)))
            elif c.isdecimal():
                zero = ord(c) - unicodedata.decimal(c)
                places.append(((zero, zero + 9), ord(c) - zero, 10))
            elif own := next((r for r in _RANGES if r[0] <= ord(c) <= r[1]), None):
                places.append((own, ord(c) - own[0], own[1] - own[0] + 1))
            else:
                places.append(("", 0, 1))
        at, sizes = [i for _, i, _ in places], [n for _, _, n in places]
        shape = "\0".join(str(a[0]) if a else c for (a, _, _), c in zip(places, low))
        seed = blake2b(f"{tweak}:{shape}".encode("utf-8", "surrogatepass")).digest()
        blocks = [slice(k, k + BLOCK_CHARS) for k in range(0, len(at), BLOCK_CHARS)]
        for order in (blocks, blocks[::-1]) if len(blocks) > 1 else (blocks,):
            # a block's permutation depends on what the blocks before it were, which undoing it would know
            before = blake2b(seed + bytes([order is blocks]))
            for b in order:
                was = at[b]
                at[b] = self._indices(was, sizes[b], before.digest())
                before.update(repr(was).encode())
        out = []
        for (alphabet, _, _), i, c, was in zip(places, at, low, text):
            new = c if not alphabet else chr(alphabet[0] + i) if isinstance(alphabet, tuple) else alphabet[i]
            out.append(was if not alphabet else new.upper() if was != c and len(new.upper()) == 1 else new)
        return "".join(out)

    def _replace(self, kind: str, value: str) -> str:
        return getattr(self, "_" + kind)(value)

    def _email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # reserved names and the top level stay, so that the address keeps its kind
        kept = {len(labels) - 1, *(i for i, x in enumerate(labels) if x.lower() in ("example", "test", "invalid", "localhost"))}
        return f"{self.letters(local, 'local')}@{'.'.join(x if i in kept else self.letters(x, 'domain') for i, x in enumerate(labels))}"

    def _phone(self, value: str) -> str:
        """The country code stays, and a first digit of the rest that is 0 or isn't; a number has one surrogate in all formats."""
        code, digits = phone_parts(value)
        if not digits:
            return value
        low = 10 ** (len(digits) - 1)
        if digits[0] == "0":
            new = "0" + self._digits(digits[1:], "phone0")
        else:
            new = str(self.permuted(int(digits) - low, 9 * low, f"phone{len(digits)}".encode()) + low)
        return refilled(value, code + new)

    def _card(self, value: str) -> str:
        """The issuer's first digits stay; the check digit is right again."""
        digits = ascii_digits(value)
        issuer = digits[: 1 if digits[0] == "4" else 4]
        body = issuer + self._digits(digits[len(issuer) : -1], "card" + issuer)
        return refilled(value, body + luhn(body))

    def _ssn(self, value: str) -> str:
        return refilled(value, self._digits(ascii_digits(value), "ssn"))

    def _ip(self, value: str) -> str:
        """An address of a private or reserved range stays in it, any other outside of them all."""
        x = 0
        for part in value.split("."):
            x = x << 8 | int(part)
        own = next(((head, bits) for head, bits in IP_RANGES if x >> 32 - bits == head), None)
        if own:
            head, bits = own
            x = head << 32 - bits | self.permuted(x & (1 << 32 - bits) - 1, 1 << 32 - bits, b"ip%d" % head)
        else:
            x = self.permuted(x, 1 << 32, b"ip")
            while any(x >> 32 - bits == head for head, bits in IP_RANGES):
                x = self.permuted(x, 1 << 32, b"ip")
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def _ip6(self, value: str) -> str:
        """The first group stays, and which groups are zero; the others are permuted, and written as they were: short, full or plain."""
        groups = [int(g, 16) for g in ipaddress.IPv6Address(value).exploded.split(":")]
        at = [k for k, g in enumerate(groups) if g and k]
        tweak = "ip6:" + ",".join([str(groups[0]), *map(str, at)])
        for k, i in zip(at, self._indices([groups[k] - 1 for k in at], [0xFFFF] * len(at), tweak.encode())):
            groups[k] = i + 1
        new = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
        full = all(len(g) == 4 for g in value.split(":"))
        text = str(new) if "::" in value else new.exploded if full else ":".join(f"{g:x}" for g in groups)
        return text.upper() if re.search("[A-F]", value) else text

    def _iban(self, value: str) -> str:
        whole = value.replace(" ", "")
        body = self.letters(whole[4:], "iban" + whole[:2])
        new = iter(whole[:2] + iban_digits(whole[:2], body) + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _key(self, value: str) -> str:
        head = re.match(r"AKIA|gh[pousr]_|xox[abp]-|sk-|eyJ", value)[0]
        return head + self.letters(value[len(head) :], "key" + head)

    def _secret(self, value: str) -> str:
        """Hexadecimal digits stay such, of one case; anything else exchanges letters."""
        if len(value) > 256 or not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            return self.letters(value, "secret")
        upper = re.search("[A-F]", value) is not None
        x, size, tweak = int(value, 16), 16 ** len(value), f"hex{len(value)}{upper}".encode()
        while True:
            x = self.permuted(x, size, tweak)
            new = f"{x:0{len(value)}x}"
            if not upper:
                return new
            if re.search("[a-f]", new):  # or it could meet the surrogate of a value in lower case
                return new.upper()

    def given_name(self, value: str, gender: str) -> str:
        """Known names move along a ring of their gender and script."""
        return _cased(self._next[gender, value.lower()], value)

    def name(self, value: str) -> str:
        """Other names: pronounceable ones in a-z, exchanged letters otherwise; hyphened parts each."""
        return "".join(x if x in "-'’" else self._surname(x) for x in re.split(r"([-'’])", value))

    def _surname(self, value: str) -> str:
        low = value.lower()
        if not low or not (low.isascii() and low.isalpha()) or len(low) > 64:
            return self.letters(value, "name")
        # all names of lengths that take this many syllables, numbered and permuted
        k = _syllables(len(low))
        first = min(n for n in range(1, len(low) + 1) if _syllables(n) == k)
        x, size = sum(26**n for n in range(first, len(low))), len(_SYLLABLES) ** k
        x += sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(low)))
        while True:
            x = self.permuted(x, size, b"surname")
            new, rest = "", x
            for _ in range(k):
                rest, i = divmod(rest, len(_SYLLABLES))
                new += _SYLLABLES[i]
            # what is a known given name or a title moves on, so that none is met twice
            if new not in _GIVEN_GENDER and new.capitalize() not in _TITLE_GENDER:
                return _cased(new, value)


def _syllables(letters: int) -> int:
    """Syllables that can tell all names of up to so many letters apart."""
    return math.ceil((letters * math.log(26) + math.log(26 / 25)) / math.log(len(_SYLLABLES)) - 1e-9)


def _cased(new: str, like: str) -> str:
    return new.upper() if len(like) > 1 and like.isupper() else new.lower() if like.islower() else new.capitalize()


def luhn(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def is_card(digits: str) -> bool:
    """Whether an issuer has such numbers, and the check digit is right; other long numbers aren't personal data."""
    return CARDS.fullmatch(digits) is not None and luhn(digits[:-1]) == digits[-1]


def _is_ip6(value: str) -> bool:
    """Whether a text is an address of version 6 that tells of someone: three groups at least aren't zero."""
    try:
        groups = ipaddress.IPv6Address(value).exploded.split(":")
    except ValueError:
        return False
    return sum(int(g, 16) > 0 for g in groups) > 2


def iban_digits(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


@lru_cache(maxsize=1)
def _cues() -> ahocorasick.Automaton:
    """Titles and known given names, as written and in capitals."""
    found = ahocorasick.Automaton()
    for word in {*_TITLE_GENDER, *(x for ns in GIVEN.values() for n in ns for x in (n, n.upper()))}:
        found.add_word(word, word)
    found.make_automaton()
    return found


def _bounded(text: str, start: int, end: int) -> bool:
    return not (start and (text[start - 1].isalnum() or text[start - 1] in "_-@") or end < len(text) and (text[end].isalnum() or text[end] in "_@"))


def people(text: str, surrogates: Surrogates) -> list[Entity]:
    """Names after a title, known given names with a surname, and all further mentions of these in the text.

    Names start with no small letter. A mention in small letters counts where it stands alone between marks;
    among words it may be an ordinary one ("you may go", with Mrs May in the text). A name that also
    stands so among words stays where a sentence begins, unless a cue names it there. Where cues overlap, all count; a name of
    over 64 letters exchanges its letters. Of two readings of a word (given
    name and surname) the first in the text holds for all its mentions.
    """
    found: dict[str, str | None] = {}  # each name in lower case, and its gender if it is a known given name
    cued: set[int] = set()  # where the names of cues stand
    for last, cue in _cues().iter(text):
        start, end = last + 1 - len(cue), last + 1
        if not _bounded(text, start, end) or end < len(text) and text[end] == "-":
            continue
        title = cue in _TITLE_GENDER
        m = (_NAMES if title else _SURNAME).match(text, end)
        if not m:
            continue
        words, places = ([], []) if title else ([cue], [start])
        for word in _WORD.finditer(m[1]):
            x = word[0]
            if x[0].islower() or x.lower() in OFFICES or x in _TITLE_GENDER or cue.isupper() and len(cue) > 3 and not x.isupper():
                break
            words.append(x)
            places.append(m.start(1) + word.start())
        if len(words) < (1 if title else 2):
            continue
        cued.update(places)
        gender = _TITLE_GENDER[cue] if title else None
        for i, x in enumerate(words):
            known = _GIVEN_GENDER.get(x.lower()) if i + 1 < len(words) or len(words) == 1 else None
            if known:
                known = gender if gender and (gender, x.lower()) in surrogates._next else known
            found.setdefault(x.lower(), known)
    if not found:
        return []
    out, seen = [], []
    for m in _WORD.finditer(text):
        word = m[0]
        pieces = [(word, m.start())] if word.lower() in found else [(x[0], m.start() + x.start()) for x in re.finditer(r"[^\W\d_]+", word)]
        seen += [(x, at) for x, at in pieces if x.lower() in found and _bounded(text, at, at + len(x))]
    alone = {at for x, at in seen if x[0].islower() and not (_WORD_END.search(text, max(0, at - 8), at) or _WORD_START.match(text, at + len(x)))}
    ordinary = {x for x, at in seen if x[0].islower() and at not in alone}
    for x, at in seen:
        if at in alone or not x[0].islower() and (at in cued or x.lower() not in ordinary or not _SENTENCE.search(text, max(0, at - 40), at)):
            if len(x) > 2 or not x[0].islower():
                gender = found[x.lower()]
                out.append(Entity(at, at + len(x), "given" if gender else "name", x.lower(), surrogates.given_name(x, gender) if gender else surrogates.name(x)))
    return out


def entities(text: str, surrogates: Surrogates) -> list[Entity]:
    """The entities of a text, in order and apart; of two that overlap the first stays, or the longer one."""
    found: list[Entity] = []
    if _NUMERIC_START.search(text):
        for m in NUMBERS.finditer(text):
            kind = "card" if m.lastgroup == "gap" else m.lastgroup
            value, start = m[0], m.start()
            if kind == "email":
                start += len(value) - len(value.lstrip(".+-_"))
                value = value.lstrip(".+-_")
                if value.startswith("@"):
                    continue
            if kind == "iban" and iban_digits(value[:2], value.replace(" ", "")[4:]) != value[2:4]:
                continue
            if kind == "card" and not is_card(ascii_digits(value)):
                continue
            if kind == "ip6" and not _is_ip6(value):
                continue
            if kind == "local":
                if not 9 <= len(ascii_digits(value)) <= 12 or not _PHONE_CUE.search(text, max(0, start - 32), start):
                    continue
                kind = "phone"
            if kind == "ip" and _VERSION.search(text, max(0, start - 12), start):
                continue
            found.append(Entity(start, m.end(), kind, canonical(kind, value), surrogates.replace(kind, value)))
    if "=" in text or ":" in text or "-----BEGIN" in text:
        for m in SECRETS.finditer(text):
            group = next(g for g in ("a", "b", "c", "pem") if m[g])
            value = m[group]
            # a bare word after a colon is prose
            if group == "c" and m["sign"] == ":" and value.rstrip(".!?)").isalpha() and (value.islower() or value.istitle()):
                continue
            found.append(Entity(*m.span(group), "secret", value, surrogates.replace("secret", value)))
    for m in _ENTROPY.finditer(text):
        value = m[0]
        if re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value) and _SECRET_CUE.search(text, max(0, m.start() - 40), m.start()):
            found.append(Entity(*m.span(), "secret", value, surrogates.replace("secret", value)))
    found += people(text, surrogates)
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def surrogate_text(text: str, surrogates: Surrogates) -> tuple[str, list[Entity]]:
    """The text with every entity replaced, and the entities."""
    found = entities(text, surrogates)
    parts, at = [], 0
    for e in found:
        parts += [text[at : e.start], e.surrogate]
        at = e.end
    return ("".join([*parts, text[at:]]) if found else text), found


def clashes(found: list[Entity]) -> int:
    """The collision check of one text: values that share a surrogate, and values with several."""
    pairs = {(e.kind, e.value, canonical(e.kind, e.surrogate)) for e in found}
    return 2 * len(pairs) - len({p[:2] for p in pairs}) - len({(p[0], p[2]) for p in pairs})


def _each(docs: DataFrame, key: bytes, schema, row: Callable) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for part in slices(batches):
            yield row(part, part.column(at).to_pylist(), surrogates)

    return docs.mapInArrow(run, schema)


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with its ``text`` replaced by the text with surrogates; rows and other columns stay as they are.

    Null and empty texts and texts without entities stay.  A column ``n_chars``
    isn't adjusted: surrogates of most kinds keep their length.
    """
    at = docs.columns.index("text")

    def row(part: pa.RecordBatch, texts: list, surrogates: Surrogates) -> pa.RecordBatch:
        new = pa.array([t and surrogate_text(t, surrogates)[0] for t in texts], part.schema.field(at).type)
        return part.set_column(at, part.schema.field(at), new)

    return _each(docs, key, docs.schema, row)


def personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, text, n_entities, n_distinct, n_clashes, kinds``: the text with surrogates and what was replaced.

    A row for each row; a null text stays null with counts of 0.  ``kinds`` is
    the sorted, comma-joined set of kinds; ``n_clashes`` counts values of the
    text that share a surrogate or have several, which the permutations rule out.
    Values of any length are replaced in all their characters; other columns
    are ignored; an empty table gives an empty one.
    """

    def row(part: pa.RecordBatch, texts: list, surrogates: Surrogates) -> pa.RecordBatch:
        got = [surrogate_text(t, surrogates) if t else (t, []) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(e) for _, e in got], pa.int64()),
                pa.array([len({x[2:4] for x in e}) for _, e in got], pa.int64()), pa.array([clashes(e) for _, e in got], pa.int64()),
                pa.array([",".join(sorted({x.kind for x in e})) for _, e in got], pa.string()),
            ],
            ["doc_id", "text", "n_entities", "n_distinct", "n_clashes", "kinds"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _each(rows, key, "doc_id long, text string, n_entities long, n_distinct long, n_clashes long, kinds string", row)


def conflicts(docs: DataFrame, key: bytes) -> DataFrame:
    """The collision check over all documents, both ways: ``kind, value, surrogate, n`` of surrogates of several values (value null) and values with several surrogates (surrogate null). Empty if all is well."""

    def row(part: pa.RecordBatch, texts: list, surrogates: Surrogates) -> pa.RecordBatch:
        got = sorted({(e.kind, e.value, canonical(e.kind, e.surrogate)) for t in texts if t for e in entities(t, surrogates)})
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(3)], ["kind", "value", "surrogate"])

    distinct = _each(docs.select(F.col("text").cast("string")), key, "kind string, value string, surrogate string", row).distinct()
    none = F.lit(None).cast("string")
    shared = distinct.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).select("kind", none.alias("value"), "surrogate", "n")
    split = distinct.groupBy("kind", "value").agg(F.count("*").alias("n")).select("kind", "value", none.alias("surrogate"), "n")
    return shared.unionByName(split).filter("n > 1")
