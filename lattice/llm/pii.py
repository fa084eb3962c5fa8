"""Personal data replaced by surrogates of the same type and form.

Entities are found by patterns and brought to a canonical form, so that mentions of one written in several
ways are one. A surrogate comes from a keyed permutation of all values of the entity's form: a Feistel
network over the mixed radix of its digits and letters, and in its order the next value of the same kind. Two
values of a form never meet, none is its own surrogate, the same value always gets the same one, nothing is
stored, and separators, case, issuer digits, the check digit of cards and private address ranges stay as
they were. Names are not of a fixed form: they are spelt from syllables of their script with the ending of
their gender, drawn by the key; one given name has one stem whatever the title. Names are known by a title;
in the same text they are then replaced without it too. A name that no title ever goes with is not found.

Collision check: the distinct entities of the corpus are compared with all surrogates. Of surrogates that
meet all but one draw again, and so do those that are a real entity of the corpus, but for forms of so few values
that all may be in use (see ``checked``). Hardly any do; those few are what tasks need to know to replace
the same way everywhere, and all that may differ between the surrogates of two corpora.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.shared import Task, drop_table, small_batches, table

EXCEPTIONS = 100_000  # entities that may draw again; more is an error
WIDE = 5  # syllables of a name beyond the first: 7.5e10 names of a script

_TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f",
    "dr": "n", "prof": "n",
    "г-н": "m", "господин": "m", "г-жа": "f", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
_NAME = r"[^\W\d_a-z](?:[^\W\d_]|['’](?=[^\W\d_]))[^\W\d_]*(?:[-'’][^\W\d_]+)*"
_PARTICLES = r"(?:(?:de|del|la|las|los|da|di|du|van|von|der|den)[ \u00a0]+)*"
PATTERNS = (
    ("secret", re.compile(r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|key)\b\s*[=:]\s*[\"']?)([A-Za-z0-9_+/-]{12,})")),
    ("secret", re.compile(r"(?i:\b(?:passwd|password|passphrase|pwd)\b\s*[=:]\s*[\"']?)([^\s\"'<>,;\0]{6,})")),
    ("secret", re.compile(r"\b((?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,})\b")),
    ("email", re.compile(r"(?<![\w.+%-])([A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![\w-])")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b(?<=\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])([0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")),
    ("ip", re.compile(r"(?<![\w.])(?<!version )(?<!Version )((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("card", re.compile(r"(?<![\w.+-])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.-])(0\d(?:[ .-]\d{2}){4})(?![\w-])")),
    ("phone", re.compile(r"(?<![\d+])(?<!isbn )(?<!ISBN )(\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")),
    ("name", re.compile(rf"\b(?i:({'|'.join(_TITLES)}))\b\.?[ \u00a0]+{_PARTICLES}({_NAME})(?:[ \u00a0]+{_PARTICLES}({_NAME}))?")),
)
#: Quick tests: a text without these cannot hold the entity.
_HINTS = {"email": "@", "ip": ".", "ipv6": ":", "name": " "}
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Mention:
    """A stretch of text to replace. kind and value say what it is a mention of."""

    start: int
    stop: int
    kind: str
    value: str


def mentions(text: str) -> list[Mention]:
    """All mentions, in order, none overlapping; what an earlier pattern of PATTERNS took is closed to later ones."""
    found: list[Mention] = []
    digits = bool(_DIGIT.search(text))
    for kind, pattern in PATTERNS:
        if kind not in ("email", "name", "secret", "ipv6") and not digits or (hint := _HINTS.get(kind)) and hint not in text:
            continue
        own = [x for m in pattern.finditer(text) for x in _parts(kind, m)]
        if own and kind == "name":
            own = _throughout(text, own)
        if own:
            found += own
            pieces, last = [], 0
            for x in own:
                pieces += [text[last : x.start], "\0" * (x.stop - x.start)]
                last = x.stop
            text = "".join([*pieces, text[last:]])
    return sorted(found, key=lambda x: x.start)


def _throughout(text: str, titled: list[Mention]) -> list[Mention]:
    """The titled names with one gender for each given name, that of its first title that tells, and the text's untitled mentions of the same people."""
    gender: dict[str, str] = {}
    for m in titled:
        if m.kind.startswith("given") and gender.get(m.value, "given-n") == "given-n":
            gender[m.value] = m.kind
    own = [Mention(m.start, m.stop, gender.get(m.value, m.kind) if m.kind.startswith("given") else m.kind, m.value) for m in titled]
    family = {text[m.start : m.stop] for m in own if m.kind == "family"}
    given = {text[m.start : m.stop] for m in own if m.kind != "family"}
    forms = lambda names: "|".join(re.escape(n) for n in sorted(names | {n.title() for n in names if n.isupper()} | {n.upper() for n in names}, key=lambda n: (-len(n), n)))
    before = rf"(?:({forms(given)})[ \u00a0]+)?" if given else "()"
    taken = {m.start for m in own}
    for m in re.finditer(rf"(?<![\w'’-]){before}{_PARTICLES}({forms(family)})(?![\w'’-])", text):
        if m.start(2) not in taken:
            own.append(Mention(m.start(2), m.end(2), "family", m[2].lower()))
            if m[1] and m.start(1) not in taken:
                own.append(Mention(m.start(1), m.end(1), gender[m[1].lower()], m[1].lower()))
    return sorted(own, key=lambda x: x.start)


def _parts(kind: str, m: re.Match) -> list[Mention]:
    if kind == "name":
        gender = _TITLES[m[1].lower()]
        names = [g for g in (2, 3) if m[g]]
        kinds = ["family"] if len(names) == 1 else [f"given-{gender}", "family"]
        return [Mention(m.start(g), m.end(g), k, m[g].lower()) for g, k in zip(names, kinds, strict=True)]
    value = m[1]
    if kind == "email":
        value = value.lower()
    elif kind == "iban":
        value = value.replace(" ", "")
    elif kind in ("ssn", "card", "phone"):
        value = re.sub(r"[^\d+]", "", value)
        if kind == "card" and len(value) != 16 and not _luhn(value):
            return []
    elif kind == "ipv6":
        try:
            value = str(ipaddress.IPv6Address(value))
        except ValueError:
            return []
        if value in ("::", "::1"):
            return []
    elif kind == "secret" and not re.search(r"[0-9]|[A-Za-z].{15}", value):
        return []
    return [Mention(m.start(1), m.end(1), kind, value)]


class Surrogates:
    """Replacements under a key. wide: syllables of a name beyond the first; redrawn: (kind, value) -> draws beyond the first."""

    def __init__(self, key: bytes, wide: int = WIDE, redrawn: dict[tuple[str, str], int] | None = None):
        self.key, self.wide, self.redrawn = key, wide, redrawn or {}
        self.of = lru_cache(200_000)(self._of)

    def number(self, *what) -> int:
        return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=self.key, digest_size=16).digest(), "big")

    def permuted(self, x: int, n: int, tweak: str, fits: Callable[[int], bool] = lambda x: True) -> int:
        """Of 0..n-1 in the tweak's order, the next after x that fits, as x itself does: another one, unless x alone fits."""
        if n < 2:
            return x
        a = int(np.ceil(np.sqrt(float(n)))) if n < 1 << 50 else 1 << (n.bit_length() + 1) // 2
        b = -(-n // a)
        left, right = divmod(x, b)
        for r in range(4):
            left = (left + self.number(tweak, r, 0, right)) % a
            right = (right + self.number(tweak, r, 1, left)) % b
        place = left * b + right
        while True:
            place = (place + 1) % (a * b)
            left, right = divmod(place, b)
            for r in (3, 2, 1, 0):
                right = (right - self.number(tweak, r, 1, left)) % b
                left = (left - self.number(tweak, r, 0, right)) % a
            x = left * b + right
            if x < n and fits(x):
                return x

    def spelled(self, value: str, tweak: str, hold: int = 0, fits: Callable[[str], bool] = lambda s: True) -> str:
        """Digits for digits and letters for letters of ``value``; its first ``hold`` characters stay. Lower-case hex with a digit and a letter stays such hex.

        Nothing else becomes such hex, so a surrogate has its value's form and values of different forms cannot meet.
        """
        hexed = _hexed(value)
        sets = ["" if k < hold or not c.isascii() else "0123456789abcdef" if hexed else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "" for k, c in enumerate(value)]
        form = "".join("h" if hexed and s else s[:1] or c for s, c in zip(sets, value, strict=True))
        n, x = 1, 0
        for s, c in zip(sets, value, strict=True):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)

        def text(x: int) -> str:
            out = []
            for s, c in zip(reversed(sets), reversed(value), strict=True):
                if s:
                    x, k = divmod(x, len(s))
                    c = s[k]
                out.append(c)
            return "".join(reversed(out))

        return text(self.permuted(x, n, f"{tweak}:{form}", lambda y: _hexed(text(y)) == hexed and fits(text(y))))

    def _of(self, kind: str, value: str) -> str:
        """The surrogate of a canonical value."""
        draw = f"#{n}" if (n := self.redrawn.get((kind, value), 0)) else ""
        if kind == "ipv6":
            number, size = int(ipaddress.IPv6Address(value)), 1 << 112  # the first group stays
            plain = lambda x: x > 1
            return str(ipaddress.IPv6Address(number >> 112 << 112 | self.permuted(number % size, size, f"ipv6{number >> 112}{draw}", plain)))
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            labels = domain.split(".")
            hold = 2 if re.search(r"(^|\.)example\.(com|org|net)$", domain) else 1  # names kept for examples, and the top level
            near = hold == 1 and labels[-1] in ("com", "org", "net")  # beside the names kept for examples, which it must not become
            labels[:-hold] = [self.spelled(x, "label", 0, lambda s, last=k == len(labels) - 2: not (near and last and s == "example")) for k, x in enumerate(labels[:-hold])]
            return f"{self.spelled(local, 'local@' + domain + draw)}@{'.'.join(labels)}"
        if kind == "ip":
            number = int(ipaddress.ip_address(value)) if _plain_ip(value) else sum(int(p) << 8 * k for k, p in enumerate(reversed(value.split("."))))
            base, size = next(((b, n) for b, n in _PRIVATE if b <= number < b + n), (0, 1 << 32))
            public = size == 1 << 32
            text = lambda x: ".".join(str(base + x >> s & 255) for s in (24, 16, 8, 0))
            fits = lambda x: _plain_ip(text(x)) == _plain_ip(value) and not (public and any(b <= x < b + n for b, n in _PRIVATE))
            return text(self.permuted(number - base, size, f"ip{base}{draw}", fits))
        if kind == "card":
            valid = _luhn(value)
            return self.spelled(value, "card" + draw, 1, lambda s: _luhn(s) == valid)
        if kind == "phone":
            hold = min(3, len(value) - 7) if value.startswith("+") else int(value.startswith("0"))
            return self.spelled(value, "phone" + draw, max(0, 2 if value.startswith("+1") else hold))
        if kind == "iban":
            return self.spelled(value, "iban" + draw, 2)
        if kind in ("ssn", "secret"):
            return self.spelled(value, kind + draw)
        return self._name(kind, value)

    def _name(self, kind: str, value: str) -> str:
        first = ord(value[0])
        script = "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"
        onsets, vowels, endings = _SPELLING[script]
        x = self.number(kind.split("-")[0], value, self.redrawn.get((kind, value), 0))
        out = []
        for _ in range(1 + self.wide):
            x, a = divmod(x, len(onsets))
            x, b = divmod(x, len(vowels))
            out.append(onsets[a] + vowels[b])
        return "".join(out) + endings.get(kind, endings["family"])

    def replace(self, text: str, found: list[Mention]) -> str:
        out, last = [], 0
        for m in found:
            out += [text[last : m.start], _poured(self.of(m.kind, m.value), text[m.start : m.stop], m.kind)]
            last = m.stop
        return "".join([*out, text[last:]])


# What names are spelt from, and the endings that tell the gender.
_SPELLING = {
    "latin": (tuple("bdfgklmnprstv"), ("a", "e", "i", "o", "u"), {"given-m": "n", "given-f": "na", "given-n": "s", "family": "l"}),
    "cyrillic": (tuple("бвгдзклмнпрст"), ("а", "е", "и", "о", "у"), {"given-m": "н", "given-f": "на", "given-n": "с", "family": "в"}),
    "greek": (tuple("βγδζκλμνπρστφ"), ("α", "ε", "ι", "ο", "υ"), {"given-m": "ς", "given-f": "να", "given-n": "ν", "family": "ου"}),
}

# Private and loopback address ranges, first address and size.
_PRIVATE = ((10 << 24, 1 << 24), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16), (127 << 24, 1 << 24))


def _hexed(value: str) -> bool:
    return bool(re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", value))


def _plain_ip(value: str) -> bool:
    a, *_, d = map(int, value.split("."))
    return 1 <= a <= 223 and 1 <= d <= 254


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _poured(surrogate: str, mention: str, kind: str) -> str:
    """The surrogate in the mention's form: its separators, or its case."""
    if kind in ("ssn", "card", "phone", "iban"):
        own = iter(surrogate)
        return "".join(next(own) if c.isalnum() or c == "+" else c for c in mention)
    if kind in ("email",) or kind.startswith("given") or kind == "family":
        return surrogate.upper() if mention.isupper() else surrogate.title() if kind != "email" and mention[0].isupper() else surrogate
    return surrogate


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = sorted({(m.kind, m.value) for t in batch.column(0).to_pylist() if t for m in mentions(t)})
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in found], pa.string()), "value": pa.array([v for _, v in found], pa.string())})


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes, wide: int) -> Iterator[pa.RecordBatch]:
    """(kind, value, draw) with the surrogate of that draw."""
    for batch in batches:
        kinds, values, draws = (c.to_pylist() for c in batch.columns)
        named = Surrogates(key, wide, {(k, v): d for k, v, d in zip(kinds, values, draws, strict=True)})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([named._of(k, v) for k, v in zip(kinds, values, strict=True)], pa.string())], names=[*batch.schema.names, "surrogate"])


#: Entities of forms with room enough that a surrogate can always be none of the corpus' own.
_ROOMY = """kind = 'family' or kind like 'given%' or kind = 'ipv6' or kind = 'ip' and not value rlike '^(10|127|172|192)[.]'
    or kind = 'email' and length(substring_index(value, '@', 1)) >= 8 or kind in ('ssn', 'card', 'phone', 'iban', 'secret') and length(regexp_replace(value, '[^A-Za-z0-9]', '')) >= 9"""


def checked(entities: DataFrame, key: bytes, rounds: int = 20) -> tuple[int, dict[tuple[str, str], int]]:
    """Syllables of names, and the draws of entities whose surrogate met another's or, in a roomy form, a real entity of the kind.

    entities: distinct (kind, value). Genders and families are spelt apart, so kinds cannot meet. The
    syllables are fixed, so a name's surrogate does not depend on the corpus unless it met something.
    A surrogate that is still a real entity after ``rounds`` draws stays, as its form is full; that two still meet is an error.
    """
    redrawn: dict[tuple[str, str], int] = {}
    kept = redrawn
    sort = F.substring_index("kind", "-", 1)
    real = entities.select(sort.alias("real_sort"), F.col("value").alias("real_value")).distinct()
    for _ in range(rounds):
        known = [(k, v, d) for (k, v), d in redrawn.items()]
        draws = entities.withColumn("draw", F.lit(0))
        if known:
            again = entities.sparkSession.createDataFrame(known, "kind string, value string, d int")
            draws = entities.join(F.broadcast(again), ["kind", "value"], "left").select("kind", "value", F.coalesce("d", F.lit(0)).alias("draw"))  # EXCEPTIONS rows at most
        drawn = table(draws.select("kind", "value", "draw").mapInArrow(Task(_drawn, key=key, wide=WIDE), "kind string, value string, draw int, surrogate string"), "drawn")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("draw", "value"))
        met = drawn.withColumn("place", place).where("place > 1").select("kind", "value", "draw")
        taken = drawn.where(_ROOMY).join(real, (sort == F.col("real_sort")) & (F.col("surrogate") == F.col("real_value")), "left_semi").select("kind", "value", "draw")
        apart = met.isEmpty()
        found = met.unionAll(taken).distinct().limit(EXCEPTIONS + 1).collect()
        drop_table(drawn)
        if not found:
            return WIDE, redrawn
        if len(found) + len(redrawn) > EXCEPTIONS:
            break
        kept, redrawn = redrawn, redrawn | {(k, v): d + 1 for k, v, d in found}
    if apart and len(found) <= EXCEPTIONS:
        return WIDE, kept
    raise RuntimeError("surrogates still meet")


def _replace(batches: Iterator[pa.RecordBatch], key: bytes, shared) -> Iterator[pa.RecordBatch]:
    """Batches of (text, more) to (text, more, _entities)."""
    named = Surrogates(key, *shared.value)
    for batch in batches:
        texts, counts = batch.column(0).to_pylist(), []
        for k, t in enumerate(texts):
            found = mentions(t) if t else []
            counts.append(len(found))
            if found:
                texts[k] = named.replace(t, found)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names, "_entities"])


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of ``docs``, texts with surrogates, and ``_entities``, how many mentions were replaced (a column of that name gives way). n_chars, if there, follows.

    Null, empty and clean texts stay as they are. The same key gives the same surrogates in every run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    entities = table(docs.select("text").mapInArrow(Task(_entities), "kind string, value string").distinct(), "entities")
    shared = spark.sparkContext.broadcast(checked(entities, key))
    drop_table(entities)
    more = [f for f in docs.schema.fields if f.name != "text"]
    kinds = "".join(f", _{k} {f.dataType.simpleString()}" for k, f in enumerate(more))
    own = docs.select("text", *(F.col(f"`{f.name}`").alias(f"_{k}") for k, f in enumerate(more)))
    made = own.mapInArrow(Task(_replace, key=key, shared=shared), f"text string{kinds}, _entities long")
    places = {f.name: k for k, f in enumerate(more)}
    out = made.select(*(F.col("text") if n == "text" else F.col(f"_{places[n]}").alias(n) for n in docs.columns if n != "_entities"), "_entities")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
