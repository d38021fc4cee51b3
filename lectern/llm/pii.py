"""Surrogates for personal data.

Detected entities are replaced by keyed stand-ins of the same type: mailboxes,
telephone, card, account and social-security numbers, IP addresses, secrets
and names. A stand-in keeps the format of each mention (separators, case,
length, check digits, private or public address, country code) and a name
keeps script, and gender if it is a listed given name. One entity, however it is written, has one stand-in
everywhere (coreference), and two entities have two (distinctness): numbers,
mailboxes and secrets go through a keyed permutation of all strings of their
shape (addresses, of all addresses of their class) that leaves none in its
place; the mailboxes of a domain stay in one domain; names are drawn by a keyed hash, each time from a space of one more
syllable. A check over the corpus then finds stand-ins that meet, that equal
their own original, or names that equal another original name, and redraws
them until none is left.

The check moves distinct entities only, never texts. Redrawn entities are
carried to the tasks when they are few (``REDRAWN_AT_ONCE``), else joined to the
documents that mention them.

Defined results: null texts stay null and empty ones empty; a text without
entities stays as it is; texts are searched whole, in time linear in their
entities; repeated rows get equal results; an empty table gives an empty
result; further columns, the id among them, keep their names and values.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

KEY = "lectern"
#: Redrawn entities up to which they travel with the tasks (some 100 bytes each).
REDRAWN_AT_ONCE = 20_000
#: Rounds of drawing anew after which a kind counts as used up, which is an error.
ROUNDS = 64
#: Kinds drawn from a space that grows with each attempt, so that no stand-in need be an original.
DRAWN = ("surname", "given_u")

# Given names by gender and forms of address, with the gender they tell.
FEMALE = "Anna Maria Marie Emma Mary Linda Julia Laura Sarah Lisa Sophie Claire Camille Carmen Elena Lucia Isabel Teresa Ingrid Katharina Ursula Monika Susan Karen Nancy Helen Alice Emily Olivia Charlotte".split()
MALE = "John James Robert Michael William David Richard Thomas Peter Hans Klaus Jürgen Stefan Wolfgang Jean Pierre Michel Jacques Louis Antoine José Juan Carlos Miguel Pedro Luis Javier Daniel Andrew George".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
_GENDER = {n: "f" for n in FEMALE} | {n: "m" for n in MALE}
_SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το ζα ζε ζο".split(),
}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w+.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")
_PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![\w-])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,}={0,2})")
_DIGIT = re.compile("[0-9]")
_TITLED = re.compile(r"\.? ([^\W\d_][\w'’-]*)(?: ([^\W\d_][\w'’-]+))?")
_LAST = re.compile(r" ([^\W\d_][\w'’-]+)")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    canonical: str


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


_names: list = []


def _name_automaton():
    if not _names:
        import ahocorasick

        a = ahocorasick.Automaton()
        for n in [*_GENDER, *TITLES]:
            a.add_word(n, n)
        a.make_automaton()
        _names.append(a)
    return _names[0]


def detect(text: str) -> list[Entity]:
    """The entities of a text in order, none within another; the first kind listed wins."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "=" in text or ":" in text:
            found += [Entity(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text) if _DIGIT.search(m[1])]
        found += [Entity(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split("."))) for m in _IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
        found += [Entity(*m.span(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and _iban_ok(m[0].replace(" ", ""))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(Entity(*m.span(), "card", digits))
        found += [Entity(*m.span(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)]
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15:
                found.append(Entity(*m.span(), "phone", digits[-10:] if len(digits) == 11 and digits[0] == "1" else digits))
    for end, word in _name_automaton().iter(text):
        start = end + 1 - len(word)
        if (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or text[end + 1 : end + 2].isalnum():
            continue
        if word in TITLES:
            m = _TITLED.match(text, end + 1)
            if not m or not m[1][:1].isupper() or m[1] in TITLES:
                continue
            if m[2] and m[2][:1].isupper():  # two capitalised words: a given name, known or not, and the surname
                found.append(Entity(*m.span(1), f"given_{_GENDER.get(m[1], 'u')}", m[1]))
                found.append(Entity(*m.span(2), "surname", m[2]))
            elif len(m[1]) > 1:
                found.append(Entity(*m.span(1), "surname", m[1]))
        else:
            m = _LAST.match(text, end + 1)
            if m and m[1][:1].isupper() and m[1] not in _GENDER:
                found.append(Entity(start, end + 1, f"given_{_GENDER[word]}", word))
                found.append(Entity(*m.span(1), "surname", m[1]))
    order = {k: i for i, k in enumerate(("email", "secret", "ip", "iban", "card", "ssn", "phone"))}
    taken: list[Entity] = []  # in order and apart, so that only the neighbours can overlap
    for e in sorted(found, key=lambda e: (order.get(e.kind, 9), e.start, -e.end)):
        k = bisect.bisect(taken, (e.start,))
        if (not k or taken[k - 1].end <= e.start) and (k == len(taken) or e.end <= taken[k].start):
            taken.insert(k, e)
    return taken


def _prf(key: str, *parts: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:24], "big")


def _permuted(key: str, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of all lists of digits with these radices that leaves none in its place.

    Between a Feistel network, which adds modulo each half, and its inverse all lists move on by one.
    """
    half = (len(values) + 1) // 2
    mods = [1, 1]
    for k, n in enumerate(sizes):
        mods[k >= half] *= n
    sides = [0, 0]
    for k, (v, n) in enumerate(zip(values, sizes, strict=True)):
        sides[k >= half] = sides[k >= half] * n + v
    turn_by = lambda turn: _prf(key, tweak, sizes, turn, sides[1 - turn % 2])
    for turn in range(4):
        sides[turn % 2] = (sides[turn % 2] + turn_by(turn)) % mods[turn % 2]
    at = (sides[0] * mods[1] + sides[1] + 1) % (mods[0] * mods[1])
    sides[:] = divmod(at, mods[1])
    for turn in reversed(range(4)):
        sides[turn % 2] = (sides[turn % 2] - turn_by(turn)) % mods[turn % 2]
    out = []
    for k in reversed(range(len(sizes))):
        side = k >= half
        sides[side], v = divmod(sides[side], sizes[k])
        out.append(v)
    return out[::-1]


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _same_shape(key: str, tweak: str, s: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Letters for letters and digits for digits, other characters stay; different strings stay different."""
    which = [next((c for c in classes if x in c), "") for x in s]
    picked = [(c.index(x), len(c)) for x, c in zip(s, which, strict=True) if c]
    if not picked:
        return s
    new = iter(_permuted(key, tweak, [v for v, _ in picked], [n for _, n in picked]))
    return "".join(c[next(new)] if c else x for x, c in zip(s, which, strict=True))


# Private, loopback and other reserved networks as the octets that stay, the ranges of the next one and how many follow it.
_NETWORKS = (((10,), None), ((192, 168), None), ((172,), (16, 32)), ((127,), None))
_RESERVED = (0, *range(224, 256))


def _class(address: str) -> int:
    """0 for public addresses, else which network."""
    ip = [int(x) for x in address.split(".")]
    for k, (head, between) in enumerate(_NETWORKS, 1):
        if tuple(ip[: len(head)]) == head and (between is None or between[0] <= ip[len(head)] < between[1]):
            return k
    return len(_NETWORKS) + 1 if ip[0] in _RESERVED else 0


def _address(key: str, tweak: str, address: str) -> str:
    """Another address of the same class; only the octets that vary within it are permuted."""
    ip, kind = [int(x) for x in address.split(".")], _class(address)
    if not kind:  # nearly all addresses are public: few steps of the permutation's cycle lead out and back
        while True:
            ip = _permuted(key, tweak, ip, [256] * 4)
            new = ".".join(map(str, ip))
            if not _class(new) and new != address:
                return new
    if kind > len(_NETWORKS):
        first, *rest = _permuted(key, f"{tweak}/{kind}", [_RESERVED.index(ip[0]), *ip[1:]], [len(_RESERVED), 256, 256, 256])
        return ".".join(map(str, (_RESERVED[first], *rest)))
    head, between = _NETWORKS[kind - 1]
    low, high = between or (0, 256)
    rest = ip[len(head) :]
    next_, *rest = _permuted(key, f"{tweak}/{kind}", [rest[0] - low, *rest[1:]], [high - low, *[256] * (len(rest) - 1)])
    return ".".join(map(str, (*head, next_ + low, *rest)))


@functools.lru_cache(maxsize=1 << 16)
def surrogate(key: str, kind: str, canonical: str, attempt: int = 0) -> str:
    """The stand-in of an entity in canonical form. attempt: how often it was redrawn."""
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{_same_shape(key, tweak + domain, local)}@{_same_shape(key, f'{kind}/0', name)}.{top}"
    if kind == "card":
        body = _same_shape(key, tweak, canonical[:-1], _CLASSES[:1])
        return next(body + d for d in "0123456789" if _luhn(body + d))
    if kind == "ip":
        return _address(key, tweak, canonical)
    if kind == "iban":
        body = _same_shape(key, tweak, canonical[4:])
        return next(canonical[:2] + f"{c:02d}" + body for c in range(2, 99) if _iban_ok(canonical[:2] + f"{c:02d}" + body))
    if kind in ("given_f", "given_m"):
        names = FEMALE if kind == "given_f" else MALE
        order = sorted(names, key=lambda n: _prf(key, tweak, n))
        return order[(order.index(canonical) + 1) % len(order)]
    if kind in DRAWN:
        script = "cyrillic" if "Ѐ" <= canonical[0] <= "ӿ" else "greek" if "Ͱ" <= canonical[0] <= "Ͽ" else "latin"
        x, out = _prf(key, tweak, canonical), []
        for _ in range(max(3, min(6, len(canonical) // 2)) + attempt):
            x, k = divmod(x, 30)
            out.append(_SYLLABLES[script][k])
        return "".join(out).capitalize()
    if kind == "secret" and not canonical.strip("0123456789abcdef"):
        return _same_shape(key, tweak, canonical, ("0123456789abcdef",))
    return _same_shape(key, tweak, canonical)


def written(entity: Entity, mention: str, new: str) -> str:
    """The stand-in in the format of the mention."""
    if entity.kind in ("card", "phone", "ssn", "iban"):
        marks = [k for k, c in enumerate(mention) if c.isalnum()]
        out = list(mention)
        for k, c in zip(marks[len(marks) - len(new) :], new, strict=True):
            out[k] = c
        return "".join(out)
    if entity.kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(mention, new, strict=True))
    if mention.isupper() and entity.kind in ("surname", "given_f", "given_m", "given_u"):
        return new.upper()
    return new


def replaced(text: str | None, key: str, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[Entity]]:
    """The text with stand-ins, and its entities."""
    found = detect(text) if text else []
    if not found:
        return text, []
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], written(e, text[e.start : e.end], surrogate(key, e.kind, e.canonical, attempts.get((e.kind, e.canonical), 0)))]
        at = e.end
    return "".join(out) + text[at:], found


def entities(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The distinct entities of all texts: kind, canonical and first stand-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(e.kind, e.canonical) for t in b.column(0) if t.is_valid for e in detect(t.as_py())}
            rows = sorted(seen)
            kinds, names = [k for k, _ in rows], [c for _, c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array([surrogate(key, k, c) for k, c in rows], pa.string())], ["kind", "canonical", "stand_in"])

    return docs.select(f"`{text}`").mapInArrow(run, "kind string, canonical string, stand_in string").distinct()


def redrawn(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canonical and attempt of the entities whose first stand-in meets another's, is the entity itself or, for names, is an original.

    Rounds go on until no such stand-in is left, the last draw being checked
    as well. Names get a space 30 times as large with each attempt, so they
    come to an end at any number. Numbers, mailboxes and secrets of a shape whose values are
    used up (all addresses of a small private network, say) can't: entities
    left after ``ROUNDS`` are an error that tells how many there are.
    Given names of the lists keep theirs: a list of names is permuted, so they can't meet.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "canonical", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canonical"), b.column("attempt"), pa.array([surrogate(key, *r) for r in rows], pa.string())], ["kind", "canonical", "attempt", "stand_in"])

    found = found.where(~F.col("kind").isin("given_f", "given_m"))
    now = stored(found.withColumn("attempt", F.lit(0)), "entities")
    originals = now.where(F.col("kind").isin(*DRAWN)).select("kind", F.col("canonical").alias("stand_in"), F.lit(True).alias("original"))
    for turn in range(ROUNDS + 1):
        # Of those that share a stand-in the first keeps it, unless it is that entity itself. Nobody keeps another's name.
        firsts = now.where("canonical <> stand_in").groupBy("kind", "stand_in").agg(F.min("canonical").alias("first"))
        marked = now.join(firsts, ["kind", "stand_in"], "left").join(originals, ["kind", "stand_in"], "left")
        bad = marked.where("canonical = stand_in or canonical <> first or original")
        bad = stored(bad.select("kind", "canonical", (F.col("attempt") + 1).cast("int").alias("attempt")), "redrawn")
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "canonical", "attempt")
        if turn == ROUNDS:
            left = ", ".join(f"{n} of kind {kind}" for kind, n in sorted(bad.groupBy("kind").count().collect()))
            raise ValueError(f"no stand-in of their own after {ROUNDS} rounds for {left}")
        fresh = bad.mapInArrow(draw, "kind string, canonical string, attempt int, stand_in string")
        rest = now.join(bad.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        now = stored(rest.select("kind", "canonical", "stand_in", "attempt").unionByName(fresh), "entities")


def with_surrogates(docs: DataFrame, key: str = KEY, text: str = "text", counts: bool = False) -> DataFrame:
    """The table with stand-ins in its texts; with ``counts`` also n_entities and kinds (kind:count, ordered) behind its columns."""
    found = entities(docs, key, text)
    again = redrawn(found, key)
    few = again.limit(REDRAWN_AT_ONCE + 1).collect()
    table: dict[tuple[str, str], int] = {}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if len(few) <= REDRAWN_AT_ONCE:
        table = {(r[0], r[1]): r[2] for r in few}
        own = own.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        # Texts that mention redrawn entities, by the hash of the text: equal texts mention the same.
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(h, e.kind, e.canonical) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for e in set(detect(t))]
                h, kinds, names = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["h", "kind", "canonical"])

        digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        told = own.select(digest.alias("h"), "text").mapInArrow(mentions, "h binary, kind string, canonical string").distinct()
        per_text = told.join(again, ["kind", "canonical"]).groupBy("h").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("redrawn"))
        own = own.withColumn("h", digest).join(per_text, "h", "left").drop("h")
    schema = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts, n, kinds = [], [], []
                for t, more in zip(part.column("text").to_pylist(), part.column("redrawn").to_pylist(), strict=True):
                    special = table | {(m["kind"], m["canonical"]): m["attempt"] for m in more} if more else table
                    new, seen = replaced(t, key, special)
                    texts.append(new)
                    n.append(len(seen))
                    each: dict[str, int] = {}
                    for e in seen:
                        each[e.kind] = each.get(e.kind, 0) + 1
                    kinds.append(",".join(f"{k}:{v}" for k, v in sorted(each.items())))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], ["row", "text", "n_entities", "kinds"])

    out = own.select("row", "text", "redrawn").mapInArrow(run, f"row {schema}, text string, n_entities long, kinds string")
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, *(["n_entities", "kinds"] if counts else []))
