"""PII surrogates: keyed replacements of the same type, gender, script and format.

A surrogate is a function of the key and the entity alone, so the same entity
gets the same surrogate wherever it stands, in whatever case or punctuation, with
no exchange between documents.  The function is a permutation of all values of
one format without fixed points: a Feistel network E over the value's characters
(each in its own alphabet: digits, lower-case letters of a script, vowels ...),
and then the inverse of E after one step, E(x) + 1.  Different entities therefore
get different surrogates, and none keeps its value.  ``collisions`` checks this
over the corpus, in Spark.

Kept as they are: punctuation and spaces, a phone number's first country digit or trunk 0,
the first digit and the validity of a card number's check digit, whether an
address is private, an e-mail's top-level domain, titles, particles of names.  Given names go to
names of the same gender and script.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .textblocks import laid_out, slices

KEY = b"set a secret key in production"
_ROUNDS = 6

# Alphabets by their first and last characters; a character moves within its own.
RANGES = ("09", "az", "AZ", "ßö", "øÿ", "ÀÖ", "ØÞ", "αω", "ΑΡ", "ΣΩ", "ая", "АЯ", "את", "ؠي", "कह", "ぁん", "ァン", "一鿿", "가힣")
RANGES += ("ѐџ", "ЀЏ", "άί", "όώ", "ΈΊ", "ԱՖ", "աֆ")
# Blocks in which capitals and small letters alternate, by case; only letters that change case both ways.
EXTENDED = tuple("".join(c for c in map(chr, range(*block)) if c != other(c) and len(other(c)) == 1 and back(other(c)) == c)
                 for block in ((0x100, 0x180), (0x180, 0x250), (0x1E00, 0x1F00)) for other, back in ((str.upper, str.lower), (str.lower, str.upper)))
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"

# Given names: the fixed pools from which surrogates come; names are detected by them.
GIVEN = {
    ("latin", "f"): ("Alice Amelia Anna Beatriz Camille Carla Charlotte Chloé Claire Elena Elisabeth Emily Emma Frieda Greta Hannah Ines "
                     "Isabel Jessica Johanna Julia Katharina Laura Lucía Maria Marie Olivia Petra Sophie Susan").split(),
    ("latin", "m"): ("Alejandro Andreas Anton Carlos Charles Daniel David Diego Edward François Friedrich George Hans Henri Henry Jacques "
                     "James Javier John Jürgen Klaus Louis Manuel Michael Miguel Pablo Peter Robert Thomas William").split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
_GIVEN = {name: (pool, i) for pool, names in GIVEN.items() for i, name in enumerate(sorted(names))}

_SPACE = "[ \u00a0\u202f]"
# An apostrophe before a shortened verb or a genitive ends a name.
_CAPITAL = "".join(c for c in map(chr, [*range(0x600), *range(0x1E00, 0x1F00)]) if c.isupper())
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
_SURNAME = rf"(?:[dDlL]['’])?[{_CAPITAL}](?:['’](?!(?:s|d|m|t|ll|re|ve)\b){_LETTER}|[\-\u2010\u2011]?{_LETTER})+"
_INITIAL = rf"[{_CAPITAL}](?:\.|(?={_SPACE}))(?:-[{_CAPITAL}]\.)?"
PARTICLES = "al bin da das de del della den der di do dos du el la le ten ter van vom von y zu zum zur".split()
_LAST = rf"(?:(?:{'|'.join(PARTICLES)}){_SPACE}){{0,3}}{_SURNAME}"
_FIRST = rf"(?:{'|'.join(_GIVEN)})(?:-{_SURNAME})?(?!\w)"
# Middle names and initials, then one or two surnames.
_REST = rf"(?:(?:{_FIRST}|{_INITIAL}){_SPACE})*{_LAST}(?:{_SPACE}{_INITIAL}(?={_SPACE}[{_CAPITAL}]))*(?:{_SPACE}{_LAST})?(?!\w)"
_TITLE = rf"(?:{'|'.join(TITLES)})\.?{_SPACE}"
_GROUP = "[0-9A-Fa-f]{1,4}"
_SHORTENED = "|".join([rf"(?:{_GROUP}:){{2,7}}:", *(rf"(?:{_GROUP}:){{1,{7 - k}}}(?::{_GROUP}){{1,{k}}}" for k in range(1, 7)), rf":(?::{_GROUP}){{2,7}}"])
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# What a text must hold for a pattern to be tried, as bits.
AT, DIGIT, EQUALS, NAME = 1, 2, 4, 8
# In order of precedence; the last group of a match is the entity, or the whole of it.
PATTERNS = tuple((kind, needs, re.compile(p)) for kind, needs, p in (
    ("email", AT, r"(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("secret", EQUALS, r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_\-+/=]{8,})"),
    ("secret", DIGIT, r"\b(?=AKIA|gh[pousr]_|sk-|[0-9a-f]{32}|[0-9A-F]{32})(?=[A-Za-z_\-]{0,200}\d)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})\b"),
    ("iban", DIGIT, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", EQUALS, rf"(?<![:\w])(?:{_GROUP}:){{7}}{_GROUP}(?![:\w])"),
    ("ipv6", EQUALS, rf"(?<![:\w])(?=[A-Fa-f:]*[0-9])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?=[0-9A-Fa-f:]*::)(?:{_SHORTENED})(?![:\w]|\.[0-9])"),
    ("ip", DIGIT, rf"(?<![\d.])(?=\d{{1,3}}\.\d)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("phone", DIGIT, r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\(\d{1,5}\)|[ .\-]?\d{2,5})(?:[ .\-]?\d{2,5}){1,4}(?!\d)"),
    ("phone", DIGIT, r"(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"),
    ("account", DIGIT, r"(?<!\d)\d(?:[ \-]?\d){11,18}(?!\d)"),
    ("account", DIGIT, r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    # National numbers: with a trunk 0 (dates and hours are none), in American or Russian groups, or after a word for telephone.
    ("phone", DIGIT, r"(?<![\w.,+/:\-])(?![0-9]{1,2}([./\-]) ?[0-9]{1,2}\1 ?[0-9]{2,4}(?![0-9]))"
                     r"(?![0-9]{1,2}[./\-](?:19|20)[0-9]{2}(?![0-9])|[0-9]{2}\.[0-9]{2} ?[\-–] ?[0-9]{1,2}\.[0-9]{2}(?![0-9]))(?=(?:[^0-9]{0,3}[0-9]){7,14}(?![0-9]))"
                     r"\(?0[0-9]{1,5}\)?(?:[ \u00a0]?[.\-/–]?[ \u00a0]?[0-9]{2,8}){1,5}(?![\w])"),
    ("phone", DIGIT, r"(?<![\w.\-])(?:1[ .\-])?(?:[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3}[\-/ ][0-9]{3}-[0-9]{4})(?![\w\-])"),
    ("phone", DIGIT, r"(?<![\w.\-])8[ \-]?\(?[0-9]{3}\)?[ \-]?[0-9]{3}[ \-][0-9]{2}[ \-][0-9]{2}(?![\w\-])"),
    ("phone", DIGIT, r"(?i:(?<!\w)(?:tel|phone|telephone|telefon|teléfono|téléphone|tél|mobile|mobil|móvil|handy|fax|тел|телефон)[.:]{0,2}[ \u00a0]?)"
                     r"(\(?[0-9](?:[ ()./\-]{0,2}[0-9]){5,14})(?![\w])"),
    ("name", NAME, rf"(?<!\w){_FIRST}{_SPACE}{_REST}"),
    ("name", NAME, rf"(?<!\w){_TITLE}(?:{_TITLE})*({_REST})"),
))
KINDS = tuple(dict.fromkeys(k for k, _, _ in PATTERNS))


def _numbers(key: bytes, label: str, values: list[int], radices: list[int]) -> list[int]:
    """Keyed numbers, one below each radix, that depend on the values."""
    seed = hashlib.blake2b(f"{label}|{values}".encode(), key=key).digest()
    need, stream, block = 8 * len(radices), seed, 0
    while len(stream) < need:
        block += 1
        stream += hashlib.blake2b(seed + block.to_bytes(4, "big")).digest()
    return [int.from_bytes(stream[8 * i: 8 * i + 8], "big") % r for i, r in enumerate(radices)]


def _feistel(key: bytes, label: str, x: list[int], radices: list[int], back: bool = False) -> list[int]:
    half = len(x) // 2
    sides = ((slice(0, half), slice(half, None)), (slice(half, None), slice(0, half)))
    x = list(x)
    for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        by, to = sides[r % 2]
        add = _numbers(key, f"{label}|{r}", x[by], radices[to])
        x[to] = [(a - b if back else a + b) % m for a, b, m in zip(x[to], add, radices[to], strict=True)]
    return x


def permuted(key: bytes, label: str, x: list[int], radices: list[int]) -> list[int]:
    """The next value of a keyed cycle through all values: a permutation without fixed points (given two values or more)."""
    y = _feistel(key, label, x, radices)
    for i in reversed(range(len(y))):  # plus one, with carry
        y[i] = (y[i] + 1) % radices[i]
        if y[i]:
            break
    return _feistel(key, label, y, radices, back=True)


def _walk(step: Callable[[list[int]], list[int]], x: list[int], allowed: Callable[[list[int]], bool]) -> list[int]:
    """Along the cycle to the next allowed value; a permutation of the allowed ones."""
    while True:
        x = step(x)
        if allowed(x):
            return x


def _alphabet(c: str, vowels: bool) -> tuple[str | None, str, int]:
    """(alphabet, its characters or first character, place of c)."""
    if vowels and c.isascii() and c.isalpha():
        for name in (VOWELS, CONSONANTS, VOWELS.upper(), CONSONANTS.upper()):
            if c in name:
                return name, name, name.index(c)
    for name in EXTENDED:
        if c in name:
            return name, name, name.index(c)
    for lo, hi in RANGES:
        if lo <= c <= hi:
            return lo + hi, lo, ord(c) - ord(lo)
    return None, c, 0


def letters(key: bytes, label: str, text: str, vowels: bool = False) -> str:
    """Every character moved within its alphabet; others stay."""
    found = [_alphabet(c, vowels) for c in text]
    at = [i for i, f in enumerate(found) if f[0] is not None]
    if not at:
        return text
    radices = [len(found[i][1]) if len(found[i][1]) > 1 else ord(found[i][0][1]) - ord(found[i][0][0]) + 1 for i in at]
    shape = "".join(c if f[0] is None else f"<{f[0]}>" for c, f in zip(text, found, strict=True))
    moved = permuted(key, f"{label}|{shape}", [found[i][2] for i in at], radices)
    out = list(text)
    for i, v in zip(at, moved, strict=True):
        name = found[i][1]
        out[i] = name[v] if len(name) > 1 else chr(ord(name) + v)
    return "".join(out)


def _recased(model: str, text: str) -> str:
    return "".join(t.upper() if m.isupper() and len(t.upper()) == 1 else t for m, t in zip(model, text, strict=True))


def _into(model: str, digits: str) -> str:
    """The digits in the places of the model's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in model)


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _private(o: list[int]) -> bool:
    return o[0] in (0, 10, 127) or o[0] >= 224 or (o[0] == 192 and o[1] == 168) or (o[0] == 172 and 16 <= o[1] < 32) or (o[0] == 169 and o[1] == 254)


def _lowered(text: str) -> str:
    """Lower case character by character, where that keeps the length."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def canonical(kind: str, text: str) -> str:
    """The entity that a mention stands for."""
    if kind == "email":
        return _lowered(text)
    if kind == "ipv6":
        return str(IPv6Address(text))
    if kind in ("phone", "account"):
        return "".join(str(int(c)) if c.isdigit() else c for c in text if c.isdigit() or c == "+")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "iban":
        return text.replace(" ", "")
    return text


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The replacement of one mention."""
    if kind == "email":
        local, domain = _lowered(text).rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return _recased(text, f"{letters(key, 'local', local)}@{letters(key, 'domain', name)}.{top}")
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        private = _private(octets)
        step = lambda x: permuted(key, "ip", x, [256] * 4)
        keep = (lambda x: _private(x) and x[0] == octets[0]) if private else (lambda x: not _private(x))
        if private:  # inside its own first byte, which holds enough private addresses to be met soon
            step = lambda x: [x[0], *permuted(key, f"ip{x[0]}", x[1:], [256] * 3)]
        return ".".join(str(x) for x in _walk(step, octets, keep))
    if kind == "ipv6":
        plain = IPv6Address(text).packed
        groups = [int.from_bytes(plain[i: i + 2], "big") for i in range(0, 16, 2)]
        return ":".join(f"{x:x}" for x in permuted(key, "ipv6", groups, [65536] * 8))
    if kind == "phone":
        digits = [int(c) for c in text if c.isdigit()]
        fixed = 1 if text.startswith("+") or digits[0] == 0 else 0
        step = lambda x: permuted(key, f"phone{digits[:fixed]}|{fixed}", x, [10] * len(x))
        moved = _walk(step, digits[fixed:], lambda x: fixed or x[0] != 0)
        return _into(text, "".join(map(str, digits[:fixed] + moved)))
    if kind == "account":
        digits = [int(c) for c in text if c.isdigit()]
        valid = _luhn(digits)
        step = lambda x: [x[0], *permuted(key, f"account{x[0]}", x[1:], [10] * (len(x) - 1))]
        return _into(text, "".join(map(str, _walk(step, digits, lambda x: _luhn(x) == valid))))
    if kind == "iban":
        plain = text.replace(" ", "")
        it = iter(plain[:4] + letters(key, f"iban{plain[:4]}", plain[4:]))
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "name":
        return "".join(_name_part(key, w) if w[:1].isalpha() and w not in PARTICLES else w for w in re.split(f"({_SPACE})", text))
    if kind == "secret":
        for digits in ("0123456789abcdef", "0123456789ABCDEF"):
            if set(text) <= set(digits) and not text.isdigit():
                moved = permuted(key, f"hex{len(text)}{digits[-1]}", [digits.index(c) for c in text], [16] * len(text))
                return "".join(digits[v] for v in moved)
    return letters(key, kind, text)


def _name_part(key: bytes, word: str) -> str:
    if word in _GIVEN:
        pool, i = _GIVEN[word]
        names = sorted(GIVEN[pool])
        return names[permuted(key, f"given{pool}", [i], [len(names)])[0]]
    # A surname that is nobody's given name must not become one.
    while True:
        word = letters(key, "surname", word, vowels=True)
        if word not in _GIVEN:
            return word


def find(text: str, holds: int = AT | DIGIT | EQUALS | NAME) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the entities of a text, in order, without overlaps; earlier patterns win."""
    spans = _Spans()
    for kind, needs, pattern in PATTERNS:
        if not holds & needs:
            continue
        for m in pattern.finditer(text):
            spans.add(*m.span(m.lastindex or 0), kind)
    parts = {w for lo, hi, kind in spans.all() if kind == "name" for w in re.split(_SPACE, text[lo:hi]) if w[1:].strip(".") and w not in PARTICLES}
    if parts:  # later mentions by one name only
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts)))})(?!\w)", text):
            spans.add(*m.span(), "name")
    return spans.all()


class _Spans:
    """Spans without overlaps, in order: the first to come stays."""

    def __init__(self) -> None:
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.kind: list[str] = []

    def add(self, lo: int, hi: int, kind: str) -> None:
        i = bisect.bisect_left(self.lo, lo)
        if (i == 0 or self.hi[i - 1] <= lo) and (i == len(self.lo) or hi <= self.lo[i]):
            self.lo.insert(i, lo)
            self.hi.insert(i, hi)
            self.kind.insert(i, kind)

    def all(self) -> list[tuple[int, int, str]]:
        return list(zip(self.lo, self.hi, self.kind, strict=True))


def replace(key: bytes, text: str, holds: int = AT | DIGIT | EQUALS | NAME) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each mention."""
    out, last, told = [], 0, []
    for lo, hi, kind in find(text, holds):
        new = surrogate(key, kind, text[lo:hi])
        out += [text[last:lo], new]
        told.append((kind, text[lo:hi], new))
        last = hi
    return "".join([*out, text[last:]]), told


_TRIGGER = np.zeros(256, np.uint8)
for _bit, _chars in ((AT, b"@"), (EQUALS, b"=:")):
    _TRIGGER[list(_chars)] = _bit
# A listed name or title anywhere, not followed by a letter: whatever the name patterns find holds one.
_NAME_HINT = rf"(?:{'|'.join([*_GIVEN, *TITLES])})(?:\PL|$)"


def _holds(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The triggers that each row holds, as bits."""
    out = np.zeros(len(offsets) - 1, np.uint8)
    some = offsets[:-1] < offsets[1:]
    if some.any():
        out[some] = np.bitwise_or.reduceat(_TRIGGER[data], offsets[:-1][some])
    out[pc.match_substring_regex(texts, r"\p{Nd}").fill_null(False).to_numpy(zero_copy_only=False)] |= DIGIT
    out[pc.match_substring_regex(texts, _NAME_HINT).fill_null(False).to_numpy(zero_copy_only=False)] |= NAME
    return out


def _replaced(texts: pa.Array, key: bytes) -> tuple[pa.Array, list[list[tuple[str, str, str]]]]:
    data, offsets = laid_out(texts)
    new: dict[int, str] = {}
    told: list[list[tuple[str, str, str]]] = [[]] * len(texts)
    for i, j in slices(offsets):
        holds = _holds(texts.slice(i, j - i), data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
        for r in np.flatnonzero(holds) + i:
            text, mentions = replace(key, texts[int(r)].as_py(), int(holds[r - i]))
            if mentions:
                new[int(r)], told[int(r)] = text, mentions
    if not new:
        return texts, told
    parts, last = [], 0
    for r in sorted(new):
        parts += [texts.slice(last, r - last), pa.array([new[r]], texts.type)]
        last = r + 1
    return pa.concat_arrays([*parts, texts.slice(last)]), told


_MENTIONS = ArrayType(StructType([StructField("kind", StringType()), StructField("surrogate", StringType()), StructField("entity_hash", StringType())]))


def with_surrogates(docs: DataFrame, text_col: str = "text", key: bytes = KEY, entities_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its text column; the other columns as they were.

    ``entities_col``: also add the mentions, as an array of (kind, surrogate,
    entity_hash), the hash being keyed.  Null texts stay null, empty ones empty;
    rows that repeat stay equal; the result for a row depends on no other row.
    """
    names = docs.columns
    at = names.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, told = _replaced(batch.column(at), key)
            columns = [text if k == at else c for k, c in enumerate(batch.columns)]
            if entities_col:
                rows = [[{"kind": k, "surrogate": s, "entity_hash": hashlib.blake2b(f"{k}|{canonical(k, e)}".encode(), key=key, digest_size=16).hexdigest()}
                         for k, e, s in row] for row in told]
                columns.append(pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string()), ("entity_hash", pa.string())]))))
            yield pa.record_batch(columns, names=[*names, entities_col] if entities_col else names)

    schema = StructType([*docs.schema.fields, *([StructField(entities_col, _MENTIONS)] if entities_col else [])])
    return docs.mapInArrow(apply, schema)


def collisions(mentions: DataFrame) -> DataFrame:
    """Breaches over (kind, surrogate, entity_hash): surrogates of two entities, and entities with two surrogates.

    Surrogates are compared in their canonical form, as entities are.
    """
    plain = F.when(F.col("kind").isin("email", "ipv6"), F.lower("surrogate")).when(
        F.col("kind").isin("phone", "account"), F.regexp_replace("surrogate", "[^0-9+]", "")).when(
        F.col("kind") == "iban", F.regexp_replace("surrogate", " ", "")).otherwise(F.col("surrogate"))
    pairs = mentions.select("kind", plain.alias("surrogate"), "entity_hash").distinct()
    shared = pairs.groupBy("kind", F.col("surrogate").alias("of")).count().where("count > 1")
    split = pairs.groupBy("kind", F.col("entity_hash").alias("of")).count().where("count > 1")
    return shared.union(split)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = with_surrogates(docs, entities_col="mentions")
    found = told.select(F.explode("mentions").alias("m")).select("m.*")
    breach = collisions(found).first()
    if breach is not None:
        raise RuntimeError(f"surrogates collide: {breach}")

    def held(kind: str) -> Column:
        return F.size(F.filter("mentions", lambda m: m["kind"] == kind)).cast("bigint")

    return told.select("doc_id", "text", F.size("mentions").cast("bigint").alias("n_entities"),
                       *(held(kind).alias(f"n_{kind}") for kind in KINDS))
