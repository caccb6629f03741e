"""Format-preserving pseudonyms for personal data and secrets.

Findings are validated (check digits, octets, calendar) and replaced by a keyed permutation
of their own format: a Feistel network over the numbers of the format, walking the cycle until
it lands inside. Equal values hence get equal pseudonyms in every document, different
values different ones, and a valid card number, date or address stays valid.

Defined cases
  null text        stays null, nothing found
  empty text       stays empty
  repeated rows    each row is rewritten, all alike
  null doc_id      rewritten like any other
  very long texts  searched as a whole; findings are short
  extra columns    ignored
  dates            any day from the year 1 to 9999; it stays before 1900, within 1900 to 2099, or behind
  letter case      e-mails that differ in case only get pseudonyms that differ in case only
  ties             where two kinds could match, the one listed first takes the text
  neighbours       where a run of digits or capitals is not valid as a whole, shorter ends and later
                   starts are tried; of a card, all groups but the last then have 3 digits or more
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the network. The key is a parameter of every function; this default is for tests and queries.
ROUNDS, DEMO_KEY = 8, b"braidscan demonstration key"
KINDS = ("secret", "email", "iban", "ip", "date", "ssn", "phone", "card")

_FIND = re.compile(
    r"(?P<secret>(?i:\b(?:password|passwd|pwd|secret|api_?key|access_?key|auth_?token|token)\s*[=:]\s*[\"']?)[^\s\"',;]{6,}"
    r"|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}"
    r"|(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z]))"
    r"|(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d))"
    r"|(?P<date>(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\d])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\- ]\d{4}(?!\d))"
    r"|(?P<card>(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d))"
    r"|(?P<blanks>(?<!\d)\d{3} \d{3} \d{4}(?!\d))"
    r"|(?P<world>(?<![\d+])\+[1-9](?:[ .\-]?\(?\d\)?){7,14}(?!\d))"
)
# The alternatives one by one, for what else begins where a finding turned out not to be valid.
_EACH = {k: re.compile(p) for k, p in zip(_FIND.groupindex, re.split(r"\|(?=\(\?P<)", _FIND.pattern))}
# Characters of an IBAN by country; country codes of one and two digits.
_IBAN_LENGTH = {c: int(n) for n, cs in (w.split(":") for w in "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS 23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT,LY 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC".split()) for c in cs.split(",")}
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_MAYBE = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)")


class Permutation:
    """A keyed permutation of range(n) for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _step(self, x: int, bits: int, tweak: bytes) -> int:
        half = bits // 2
        mask = (1 << half) - 1
        left, right = x >> half, x & mask
        size = (half + 7) // 8
        for r in range(ROUNDS):
            data = tweak + bytes([r]) + right.to_bytes(size, "big")
            f, need, block = b"", size, 0
            while len(f) < need:
                f += hashlib.blake2b(data + bytes([block]), key=self.key, digest_size=64).digest()
                block += 1
            left, right = right, left ^ (int.from_bytes(f[:size], "big") & mask)
        return left << half | right

    def __call__(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        bits = max(2, (n - 1).bit_length())
        bits += bits & 1
        y = x
        while True:
            y = self._step(y, bits, f"{tweak}:{n}".encode())
            if y < n:
                return y


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_valid(number: str) -> bool:
    return luhn_digit(number[:-1]) == number[-1]


def iban_valid(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


# The character classes a pseudonym keeps.
_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# Printable ASCII marks that may stand in a secret.
_MARKS = "!#$%&()*+-./:<=>?@[]^_`{|}~"


@functools.lru_cache(maxsize=4096)
def _run_of(block: int) -> str:
    """The printable characters of a run of 64 code points beyond ASCII: a letter's own class."""
    return "".join(c for c in map(chr, range(64 * block, 64 * block + 64)) if c > "\x7f" and c.isprintable() and not "\ud800" <= c <= "\udfff")


def _classes(text: str) -> tuple[str, ...]:
    """The classes that cover a secret's characters: digits, letters, marks, and runs beyond ASCII."""
    beyond = sorted({ord(c) // 64 for c in text if c > "\x7f"})
    return (*_SETS, _MARKS, *map(_run_of, beyond))


def _ends(kind: str, run: str, again: bool):
    """Where a finding of this kind may end in a run, likeliest first."""
    if kind == "iban":
        ends = [e for e in range(len(run), 0, -1) if (e == len(run) or run[e] == " ") and len(run[:e].replace(" ", "")) >= 12]
        size = _IBAN_LENGTH.get(run[:2])
        own = [e for e in ends if len(run[:e].replace(" ", "")) == size]
        yield from own
        yield from (e for e in (ends[:1] if size else ends) if e not in own)
    elif kind == "card":
        for e in range(len(run), 12, -1):
            if (e == len(run) or not run[e].isdigit()) and run[e - 1].isdigit():
                groups = re.split("[ -]", run[:e])
                whole = e == len(run) and not again
                if sum(map(len, groups)) >= 13 and (whole or all(len(g) > 2 for g in groups[:-1])):
                    yield e
    else:
        yield len(run)


class Pseudonyms:
    def __init__(self, key: bytes = DEMO_KEY):
        self.permute = Permutation(key)
        self.replace = functools.lru_cache(maxsize=100_000)(self._replace)

    def _mixed(self, digits: list[tuple[int, int]], tweak: str) -> list[int]:
        """Permute a number of mixed radix, given as (digit, radix)."""
        x, n = 0, 1
        for d, radix in digits:
            x, n = x * radix + d, n * radix
        y = self.permute(x, n, tweak)
        out = []
        for _, radix in reversed(digits):
            out.append(y % radix)
            y //= radix
        return out[::-1]

    def characters(self, text: str, tweak: str, sets=_SETS) -> str:
        """Each letter or digit becomes one of its own class; all else stays."""
        where = [(i, s) for i, c in enumerate(text) for s in sets if c in s]
        out = list(text)
        for (i, s), d in zip(where, self._mixed([(s.index(text[i]), len(s)) for i, s in where], tweak)):
            out[i] = s[d]
        return "".join(out)

    @staticmethod
    def _fill(pattern: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in pattern)

    def _replace(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None for what is not valid."""
        return getattr(self, "_" + kind)(text)

    def _secret(self, text: str) -> str:
        m = re.match(r"(?i)[a-z_]+\s*[=:]\s*[\"']?", text)
        head = m[0] if m else ("AKIA" if text.startswith(("AKIA", "ASIA")) else "")
        body = text[len(head) :]
        hexed = re.fullmatch(r"[0-9a-f]+", body)
        return head + self.characters(body, "secret", ("0123456789abcdef",) if hexed else _classes(body))

    def _email(self, text: str) -> str:
        """Addresses that differ in case only are one address: letters move as small ones and get their case back."""
        name, _, domain = text.rpartition("@")
        labels, dot, top = domain.rpartition(".")
        whole = name + "@" + labels
        moved = self.characters(whole.lower(), "email", _SETS[:2])
        return "".join(m.upper() if c.isupper() else m for c, m in zip(whole, moved)) + dot + top

    def _iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        if not iban_valid(flat):
            return None
        body = self.characters(flat[4:], "iban")
        check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        it = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)

    def _ip(self, text: str) -> str | None:
        octets = [int(o) for o in text.split(".")]
        if any(o > 255 for o in octets) or any(len(o) > 1 and o[0] == "0" for o in text.split(".")):
            return None
        # Addresses of 1 to 223 stay among themselves, and so do all others (0 and 224 to 255).
        if not 1 <= octets[0] <= 223:
            a, *rest = self._mixed([((octets[0] - 223) % 256 % 33, 33)] + [(o, 256) for o in octets[1:]], "ip0")
            return ".".join(map(str, [(a + 223) if a else 0, *rest]))
        a, *rest = self._mixed([(octets[0] - 1, 223)] + [(o, 256) for o in octets[1:]], "ip")
        return ".".join(map(str, [a + 1, *rest]))

    def _date(self, text: str) -> str | None:
        style = "%Y-%m-%d" if text[4] == "-" else f"%d{text[2]}%m{text[5]}%Y"
        try:
            day = datetime.datetime.strptime(text, style).date()
        except ValueError:
            return None
        # Days of 1900 to 2099 stay among themselves, likewise those before and behind, from the year 1 to 9999.
        edges = [1, datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal(), datetime.date.max.toordinal() + 1]
        first, end = next((a, z) for a, z in zip(edges, edges[1:]) if a <= day.toordinal() < z)
        moved = datetime.date.fromordinal(first + self.permute(day.toordinal() - first, end - first, "date"))
        return f"{moved.year:04d}-{moved.month:02d}-{moved.day:02d}" if text[4] == "-" else f"{moved.day:02d}{text[2]}{moved.month:02d}{text[5]}{moved.year:04d}"

    def _ssn(self, text: str) -> str | None:
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a = area - 1 - (area > 666)
        a, g, s = self._mixed([(a, 898), (group - 1, 99), (serial - 1, 9999)], "ssn")
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"

    def _phone(self, text: str) -> str:
        digits = [c for c in text if c.isdigit()]
        lead, own = digits[:-10], digits[-10:]
        radix = [8 if i in (0, 3) and d >= "2" else 2 if i in (0, 3) else 10 for i, d in enumerate(own)]
        base = [2 if r == 8 else 0 for r in radix]
        moved = self._mixed([(int(d) - b, r) for d, b, r in zip(own, base, radix)], "phone" + "".join(map(str, radix)))
        return self._fill(text, "".join(lead) + "".join(str(m + b) for m, b in zip(moved, base)))

    def _blanks(self, text: str) -> str:
        return self._phone(text)

    def _world(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3])
        return self._fill(text, code + self.characters(digits[len(code) :], "phone+" + code))

    def _card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not luhn_valid(digits):
            return None
        body = digits[0] + self.characters(digits[1:-1], "card" + digits[0])
        return self._fill(text, body + luhn_digit(body))

    def _first_valid(self, text: str, m: re.Match, again: bool) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of what is valid from where m starts; again: inside a run that was not valid."""
        kinds, start = list(_EACH), m.start()
        for kind in kinds[kinds.index(m.lastgroup) :]:
            own = m if kind == m.lastgroup else _EACH[kind].match(text, start)
            for end in _ends(kind, own[0], again) if own else ():
                new = self.replace(kind, own[0][:end])
                if new is not None:
                    return kind, start + end, new
        return None

    def rewrite(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts: dict[str, int] = {}
        if not text or not _MAYBE.search(text):
            return text, counts

        out, done, at, spent = [], 0, 0, 0
        while m := _FIND.search(text, at):
            found = self._first_valid(text, m, m.start() < spent)
            if found is None:
                at, spent = m.start() + 1, max(spent, m.end())
                continue
            kind, end, new = found
            kind = "phone" if kind in ("blanks", "world") else kind
            counts[kind] = counts.get(kind, 0) + 1
            out += (text[done : m.start()], new)
            done = at = end
        return "".join(out) + text[done:], counts


@functools.lru_cache(maxsize=4)
def _shared(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """(doc_id, text, n_replaced, n_<kind>...): every whole text with its findings replaced."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_replaced", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS])

    def run(batches):
        names = _shared(key)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                done = [names.rewrite(t.as_py()) for t in part.column(1)]
                counts = [[d[1].get(k, 0) for d in done] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([sum(d[1].values()) for d in done], pa.int64())] + [pa.array(c, pa.int64()) for c in counts],
                    schema=schema,
                )

    ddl = "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
