"""Personal data replaced by keyed surrogates.

Entities are found by their form. Each is brought to a canonical value (a phone's digits, a lower-case
address, a single word of a name), so that all its spellings share one surrogate, in all documents. The surrogate
is drawn from a keyed digest of kind, value and attempt, and takes the original's form: separators stay, digits
become digits, letters become letters of the same case and script; card and account numbers keep
their check digits right or wrong as they were; names keep the gender of title or
given name and their script.

Distinct values must get distinct surrogates, and no surrogate may be a value of the corpus. This is
checked over the whole table of distinct values, as joins; a value that loses draws again. Only the few
documents that hold such a value need to be told its attempt.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocast.llm import text as tx
from halocast.llm.sizes import sendable
from halocast.session import stored

# Titles by gender, and those of any.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Rev", "Доктор", "Профессор")
# Words of small letters inside a name.
PARTICLES = ("de", "del", "della", "der", "den", "da", "di", "do", "dos", "du", "la", "le", "van", "von", "zu", "bin", "ibn", "al", "el", "y")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ALL_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_ENTITY = re.compile("|".join((
    r"(?P<email>[^\W_][\w.%+\-]{0,63}@(?:[^\W_](?:[\w\-]{0,62})\.)+[^\W\d_]{2,24})",
    r"(?P<key>\bAKIA[0-9A-Z]{16}\b)",
    r"\b(?i:password|passwd|pwd|secret|api[_-]?key|token)\s{0,3}[=:]\s{0,3}(?P<secret>[^\s,;]*[^\s,;.])",
    rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w))",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<phone>(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<!\w)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\w))",
    r"(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))",
    r"(?P<card>(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?!\w))",
    rf"\b(?P<name>(?:(?:{_ALL_TITLES})\b\.?[ \t]+)+)(?=[^\W\d_])",
)))
_HEX = re.compile(r"\W*(?:[0-9a-f]{8,}|[0-9A-F]{8,})\W*")
_TITLE = re.compile(rf"\b(?:{_ALL_TITLES})\b")
_GENDERS = tuple((g, re.compile(rf"\b(?:{'|'.join(titles)})\b")) for g, titles in (("m", MALE), ("f", FEMALE)))
_NEXT = re.compile(r"[ \t]*([^\W\d_](?=\.)|[^\W\d_][\w'’\-]*)")  # an initial before its dot, or a word
NAMES = ("surname", "given_m", "given_f", "given", "initial")

_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord("@"), ord("="), ord(":"), *range(ord("0"), ord("9") + 1)]] = True

Entity = tuple[int, int, str, str]  # first character, one past the last, kind, canonical value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _luhn(digits: str) -> int:
    """The check digit that belongs to these leading digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def find(text: str) -> list[Entity]:
    """The entities of a text, in order, without overlap."""
    out: list[Entity] = []
    known: dict[str, str] = {}
    at = 0
    while m := _ENTITY.search(text, at):
        at, kind = m.end(), m.lastgroup
        first, last = m.span(kind)
        value = m[kind]
        if kind == "name":
            own = _names(text, last, value)
            out += own
            at = own[-1][1] if own else at
            for _, _, k, word in own:
                if k != "initial":
                    known.setdefault(word, k)
            continue
        if kind == "secret" and not any(c.isdigit() or c.isalpha() for c in value):
            continue  # masked, or an operator of code: nothing to hide and nothing to draw
        if kind == "email":
            value = value.lower()
        elif kind == "phone":
            value = _digits(value)[-10:]
        elif kind in ("ssn", "card"):
            value = _digits(value)
        elif kind == "iban":
            value = value.replace(" ", "")
        out.append((first, last, kind, value))
    return sorted(out + _mentions(text, known, out)) if known else out


def _names(text: str, at: int, titles: str) -> list[Entity]:
    """The name words from ``at`` on, up to the first word that can't be one; the last one is the surname."""
    words: list[tuple[int, str]] = []
    while (m := _NEXT.match(text, at)) and not _TITLE.fullmatch(m[1]):
        if not m[1][0].islower():
            words.append((m.start(1), m[1]))
        elif m[1] not in PARTICLES:
            break
        at = m.end() + (len(m[1]) == 1 and text[m.end(): m.end() + 1] == ".")
    while len(words) > 1 and len(words[-1][1]) == 1 and words[-1][1].isupper() and text[words[-1][0] + 1: words[-1][0] + 2] != ".":
        words.pop()  # 'I' or 'A' of what follows
    gender = next((f"given_{g}" for g, title in _GENDERS if title.search(titles)), "given")
    full = [k for k, (_, w) in enumerate(words) if len(w) > 1 or not w.isupper()]
    out = []
    for k, (first, w) in enumerate(words):
        value = re.sub(r"['’][sS]?$|-+$", "", w) or w
        kind = "surname" if full and k == full[-1] else gender if k in full else "initial"
        out.append((first, first + len(value), kind, value.lower()))
    return out


def _mentions(text: str, known: dict[str, str], found: list[Entity]) -> list[Entity]:
    """Further places of the name words, with or without a title, outside the entities found."""
    any_name = re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![^\W_])", re.IGNORECASE)
    taken = sorted(found)
    starts = [e[0] for e in taken]
    out = []
    for m in any_name.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if (k < 0 or taken[k][1] <= m.start()) and not m[0][0].islower() and (word := m[0].lower()) in known:
            out.append((*m.span(), known[word], word))
    return out


class _Draw:
    """Numbers from a keyed digest, as many as are asked for."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.pool, self.left = key, "\x1f".join(map(str, what)).encode(), 0, 1
        self.more = count()

    def __call__(self, n: int) -> int:
        if self.left < n << 16:
            block = blake2b(self.what + b"\x1f%d" % next(self.more), key=self.key).digest()
            self.pool, self.left = int.from_bytes(block, "big"), 1 << 512
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


# Letters a script's surrogates are made of, and the ranges that tell it.
_SCRIPTS = (
    ("latin", "", 0, "bcdfghklmnprstvz", "aeiou"),
    ("greek", "", 0x370, "βγδζκλμνπρστφ", "αειου"),
    ("cyrillic", "", 0x400, "бвгдзклмнпрстф", "аеиоу"),
    ("other", "", 0x530, "", ""),
)


def _letters(c: str) -> tuple[str, str]:
    at = ord(c)
    own = [s for s in _SCRIPTS if s[2] <= at][-1]
    return own[3], own[4]


def _same_class(c: str, draw: _Draw) -> str:
    """Another character of the same class, case and script."""
    if c.isdigit():
        return str(draw(10))
    if not c.isalpha():
        return c
    if ord(c) < 128:
        new = chr(97 + draw(26))
    elif (own := "".join(_letters(c))):
        new = own[draw(len(own))]
    else:  # scripts without case: a neighbour in the same block of 32 characters that is a letter, too
        block = [chr(x) for x in range(ord(c) & ~31, (ord(c) & ~31) + 32) if chr(x).isalpha()]
        return block[draw(len(block))]
    return new.upper() if c.isupper() else new


def _name(word: str, female: bool, draw: _Draw) -> str:
    consonants, vowels = _letters(word[0])
    if not consonants:
        return "".join(_same_class(c, draw) for c in word)
    n = 2 + draw(2)
    made = "".join(consonants[draw(len(consonants))] + vowels[draw(len(vowels))] for _ in range(n))
    return made[:-1] + vowels[0] if female else made + consonants[draw(len(consonants))]


#: Attempts after which a surrogate grows with each further one: at once for forms of few characters, else if ever spent.
SPENT, NEVER_SPENT = 4, 20


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical value; it grows with the attempts once its form's space is spent."""
    draw = _Draw(key, kind, value, attempt)
    made = _formed(kind, value, attempt, key, draw)
    if kind == "email":
        return made
    more = max(0, attempt - (SPENT if kind in ("secret", "phone", *NAMES) else NEVER_SPENT))
    if kind == "ip":
        return made + "".join(f".{draw(256)}" for _ in range(more))
    if kind in NAMES:
        vowels = _letters(value[0])[1]
        return made + "".join(vowels[draw(len(vowels))] if vowels else _same_class(value[0], draw) for _ in range(more))
    return made + "".join(str(draw(10)) for _ in range(more))


def _formed(kind: str, value: str, attempt: int, key: bytes, draw: _Draw) -> str:
    """A surrogate in the form of the value."""
    if kind == "email":
        local, domain = value.split("@")
        own = _Draw(key, "domain", domain, 0)
        labels = domain.split(".")
        host = ".".join("".join(_same_class(c, own) for c in label) for label in labels[:-1])
        made = "".join(_same_class(c, draw) for c in local) + (str(draw(10 ** attempt)) if attempt > 4 else "")
        return f"{made}@{host}.{labels[-1]}"
    if kind == "ip":
        private = value.startswith(("10.", "192.168.", "127.")) and attempt <= 2 * SPENT
        if private and attempt > SPENT:
            value = "10."  # the largest private network
        first = value.split(".")[0] if private else str((*range(1, 10), *range(11, 127), *range(128, 172), *range(173, 192), *range(193, 224))[draw(212)])
        second = "168" if value.startswith("192.168.") else str(draw(256))
        return f"{first}.{second}.{draw(256)}.{1 + draw(254)}"
    if kind == "card":
        made = value[0] + "".join(str(draw(10)) for _ in value[1:-1])
        right = _luhn(value[:-1]) == int(value[-1])
        return made + str((_luhn(made) + (0 if right else 1 + draw(9))) % 10)
    if kind == "iban":
        rest = "".join(_same_class(c, draw) for c in value[4:])
        right = _iban_check(value[:2], value[4:]) == value[2:4]
        return value[:2] + (_iban_check(value[:2], rest) if right else f"{draw(97):02d}") + rest
    if kind in ("phone", "ssn"):
        return "".join(str(1 + draw(9)) if k == 0 else str(draw(10)) for k, _ in enumerate(value))
    if kind == "key":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw(32)] for _ in value[4:])
    if kind == "initial":  # two letters, so that it is none of the corpus
        consonants, vowels = _letters(value[0])
        return consonants[draw(len(consonants))] + vowels[draw(len(vowels))] if consonants else _same_class(value, draw)
    if kind in NAMES:
        return _name(value, kind == "given_f" or kind == "surname" and value[-1] in "ая", draw)
    if _HEX.fullmatch(value):
        return "".join("0123456789abcdef"[draw(16)] if c.isdigit() or c.islower() else "0123456789ABCDEF"[draw(16)] if c.isalpha() else c for c in value)
    return "".join(_same_class(c, draw) for c in value)


def fitted(made: str, kind: str, original: str) -> str:
    """A canonical surrogate in the form of the original spelling."""
    if kind in ("phone", "ssn", "card"):
        keep = len(_digits(original)) - len(made)  # a country code stays
        source, out = iter(made), []
        for c in original:
            if c.isdigit():
                keep -= 1
                out.append(c if keep >= 0 else next(source))
            else:
                out.append(c)
        return "".join([*out, *source])
    if kind == "iban":
        source = iter(made)
        return "".join([*(c if c == " " else next(source) for c in original), *source])
    if kind == "email":
        return made.upper() if original.isupper() else made
    if kind in NAMES:
        return made.upper() if original.isupper() and len(original) > 1 else made[:1].upper() + made[1:] if original[0].isupper() else made
    return made


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with all entities replaced, and their number."""
    out, done, n = [], 0, 0
    for first, last, kind, value in find(text):
        made = surrogate(kind, value, attempts.get((kind, value), 0), key)
        out += [text[done:first], fitted(made, kind, text[first:last])]
        done, n = last, n + 1
    return ("".join([*out, text[done:]]), n) if n else (text, 0)


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows whose bytes can hold an entity: a digit, an @, an = or a colon, or a title."""
    data, offsets = tx.utf8(column)
    # text by text: running counts over a batch would take sixteen times its bytes
    return np.array([_TRIGGER[data[lo:hi]].any() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=bool)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple[int | None, str, str]] = []
        for i, suspect in enumerate(_suspects(batch.column(1)).tolist()):
            text = batch.column(1)[i].as_py() or ""
            if suspect or _TITLE.search(text):
                row = batch.column(0)[i].as_py()
                held += sorted({(row, kind, value) for _, _, kind, value in find(text)}, key=lambda x: x[1:])
        yield pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), *(pa.array([h[k] for h in held], pa.string()) for k in (1, 2))],
            ["id", "kind", "value"])


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, v, a, key) for k, v, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "made"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, made string")


def attempts(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, made): a surrogate for every distinct (kind, value), all different and none of them a value.

    Values that clash in a round draw again in the next; of values that drew the same, the smallest keeps it.
    """
    values = stored(values.select("kind", "value").distinct(), "values")
    settled, open_ = None, values.withColumn("attempt", F.lit(0))
    while True:
        drawn = stored(_drawn(open_, key), "drawn")
        taken = values.select("kind", F.col("value").alias("made"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "made"))
        winner = drawn.groupBy("kind", "made").agg(F.min("value").alias("value")).join(taken, ["kind", "made"], "left_anti")
        good = drawn.join(winner, ["kind", "made", "value"], "left_semi")
        bad = stored(drawn.join(winner, ["kind", "made", "value"], "left_anti").select(
            "kind", "value", (F.col("attempt") + 1).alias("attempt")), "clashes")
        settled = good if settled is None else settled.unionByName(good)
        if bad.isEmpty():
            return settled
        open_ = bad


def replace(docs: DataFrame, key: bytes = b"halocast", id_col: str = "doc_id", text_col: str = "text",
            count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in their texts; ``count_col`` adds the number of entities replaced.

    Null texts stay null and empty ones empty. Texts without entities come back unchanged. Repeated rows and null ids are
    treated like others. All columns stay, whatever their names. ``key`` decides the surrogates: the same
    key gives the same ones for the same corpus.
    """
    tx.bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    entities = stored(texts.mapInArrow(_entities, "id long, kind string, value string"), "entities")
    again = attempts(entities, key).where("attempt > 0").select("kind", "value", "attempt")
    # by document; sent out while it is small, else joined by a shuffle
    told = stored(entities.join(again, ["kind", "value"]).distinct().groupBy("id").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias("__told")).withColumnRenamed("id", "__id"), "told")
    both = docs.withColumn("__text", F.col(text_col).cast("string"))
    told = sendable(told, 10_000)
    both = both.join(told, both[id_col].cast("long").eqNullSafe(told["__id"]), "left").drop("__id")
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            told_of = batch.column(1).to_pylist()
            for i, suspect in enumerate(_suspects(batch.column(0)).tolist()):
                text = batch.column(0)[i].as_py()
                n = 0
                if text and (suspect or _TITLE.search(text)):
                    text, n = replaced(text, key, {(t["kind"], t["value"]): t["attempt"] for t in told_of[i] or ()})
                texts.append(text)
                found.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string()), pa.array(found, pa.int32())],
                                             [*batch.schema.names[2:], "__new", "__found"])

    rows = both.select("__text", "__told", *rest)
    schema = rows.drop("__text", "__told").schema
    out = rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("__new", T.StringType()), T.StructField("__found", T.IntegerType())]))
    columns = [F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, *([F.col("__found").alias(count_col)] if count_col else []))
