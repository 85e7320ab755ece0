"""Personal data replaced by surrogates of the same type, format, script and gender.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment cards (valid check digit), social security numbers, account numbers
(IBAN), long hexadecimal secrets, and names of persons (a title or a known given name, and a surname). A surrogate
comes from a keyed permutation of all values of the same format, so equal values get equal surrogates and
different values different ones: digits become digits, letters letters of the same case, script and kind (vowel or
consonant), a given name another one of the same script and gender; check digits stay valid, private addresses private.

The distinct values of the corpus are then checked: a surrogate that is itself a value of the corpus, or that two
values share, is drawn again, and only these few values are looked up when texts are rewritten.

Defined results: a null text stays null, an empty one empty. Texts without personal data are not changed. Repeated
rows get equal results. Empty tables give empty results. All other columns are kept; n_replaced must not be among them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm import shared
from pagetide.session import stage

KEY = b"pagetide"  # a caller's secret key takes its place
ROUNDS = 12  # draws before a format counts as used up
AVOID = 6  # draws that also avoid values of the corpus

# given names by script and gender; a surrogate is another name of the same row
NAMES = {
    ("latin", "f"): "Alice Anna Carla Clara Diana Elena Emma Eva Hanna Ines Julia Karin Laura Lucia Maria Marta Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Bruno Carlos Daniel David Erik Felix Georg Hugo Ivan James John Jonas Karl Leon Lukas Marco Martin Oskar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
GIVEN = {name: row for row in NAMES.values() for name in row}
# letters that stand for each other, by script, case and kind
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäèéêëìíîïòóôöùúûü", "çñß",
    "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
)
CLASS = {c: a for a in ALPHABETS for c in a}
HEX = ("0123456789abcdef", "0123456789ABCDEF")

_CAP = r"[^\W\d_a-zà-ÿа-я][^\W\d_]+"
PATTERNS = (
    ("email", re.compile(r"[\w.%+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("card", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)")),
    ("name", re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? (?:(?:{'|'.join(GIVEN)}) )?{_CAP}|(?:{'|'.join(GIVEN)}) {_CAP})(?!\w)")),
)
# texts that may hold something, found in one quick pass
MAYBE = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|[0-9A-Fa-f]{{32}}|\b(?:{'|'.join([*TITLES, *GIVEN])})\b|(?:{'|'.join(NAMES['cyrillic', 'f'] + NAMES['cyrillic', 'm'])})"


def _check_digit(digits: str) -> str:
    """The last digit that makes a card number valid."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_rest(country: str, check: str, body: str) -> int:
    """1 for a valid account number."""
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end and type of the personal data of a text, without overlaps; earlier types go first."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if kind == "card":
                digits = re.sub(r"\D", "", m[0])
                if not 13 <= len(digits) <= 19 or _check_digit(digits[:-1]) != digits[-1]:
                    continue
            if kind == "iban" and _iban_rest(m[0][:2], m[0][2:4], m[0][4:]) != 1:
                continue
            out.append((m.start(), m.end(), kind))
    rank = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
    taken: list[tuple[int, int, str]] = []
    last = -1
    for span in sorted(out, key=lambda s: (s[0], rank[s[2]], -s[1])):
        if span[0] >= last:
            taken.append(span)
            last = span[1]
    return taken


def _permuted(digits: list[int], radices: list[int], tweak: bytes, key: bytes) -> list[int]:
    """A keyed permutation of all digit strings with these radices: two halves take turns at shifting each other."""
    half = (len(digits) + 1) // 2
    sides = [(digits[:half], radices[:half]), (digits[half:], radices[half:])]
    numbers, sizes = [], []
    for values, bases in sides:
        number, size = 0, 1
        for v, b in zip(values, bases, strict=True):
            number, size = number * b + v, size * b
        numbers.append(number)
        sizes.append(size)
    for turn in range(10):
        mine, other = turn % 2, 1 - turn % 2
        seed = b"%d|%d|%s" % (turn, numbers[other], tweak)
        shift = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=64).digest())
        numbers[mine] = (numbers[mine] + shift) % sizes[mine]
    out = []
    for number, (_, bases) in zip(numbers, sides, strict=True):
        part = []
        for b in reversed(bases):
            number, d = divmod(number, b)
            part.append(d)
        out += part[::-1]
    return out


def _shuffled(value: str, tweak: str, key: bytes, alphabets=CLASS.get) -> str:
    """Every character that has an alphabet is permuted within it, all others stay."""
    own = [(i, a) for i, c in enumerate(value) if (a := alphabets(c))]
    if not own:
        return value
    pattern = "".join(a[0] if a else c for c, a in ((c, alphabets(c)) for c in value))
    digits = _permuted([a.index(value[i]) for i, a in own], [len(a) for _, a in own], f"{tweak}|{pattern}".encode(), key)
    out = list(value)
    for (i, a), d in zip(own, digits, strict=True):
        out[i] = a[d]
    return "".join(out)


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of a value; each attempt is another permutation of all values of the format."""
    tweak = f"{kind}|{attempt if attempt < ROUNDS else 0}"
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        out = f"{_shuffled(local, tweak, key)}@{'.'.join([_shuffled('.'.join(labels[:-1]), tweak + '|at', key), labels[-1]])}"
    elif kind == "secret":
        letters = HEX[value == value.upper()] if value in (value.lower(), value.upper()) else None
        out = _shuffled(value, tweak, key, (lambda c: letters) if letters else CLASS.get)
    elif kind == "card":
        digits = re.sub(r"\D", "", value)
        body = digits[0] + _shuffled(digits[1:-1], f"{tweak}|{digits[0]}", key)
        fresh = iter(body + _check_digit(body))
        out = re.sub(r"\d", lambda _: next(fresh), value)
    elif kind == "ip":
        parts = [int(p) for p in value.split(".")]
        private = lambda p: 1 if p[0] in (10, 127, 0) else 2 if p[:2] == [192, 168] or p[0] == 172 and 16 <= p[1] < 32 else 0
        keep = private(parts)
        while True:  # walks on until the address is of the same kind again
            parts = parts[:keep] + _permuted(parts[keep:], [256] * (4 - keep), f"{tweak}|{keep}|{parts[:keep]}".encode(), key)
            if private(parts) == keep:
                break
        out = ".".join(map(str, parts))
    elif kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d?", value)
        head = code[0] if code else ""
        out = head + _shuffled(value[len(head):], tweak, key)
    elif kind == "iban":
        body = _shuffled(value[4:], f"{tweak}|{value[:2]}", key)
        out = f"{value[:2]}{98 - _iban_rest(value[:2], '00', body):02d}{body}"
    elif kind == "name":
        out = " ".join(_name_part(word, tweak, key) for word in value.split(" "))
    else:
        out = _shuffled(value, tweak, key)
    if attempt >= ROUNDS:  # the format has no value left: it is made longer
        out += hashlib.blake2b(value.encode(), key=key, digest_size=6).hexdigest()
    return out


def _name_part(word: str, tweak: str, key: bytes) -> str:
    if word.rstrip(".") in TITLES:
        return word
    row = GIVEN.get(word)
    if row is None:
        return _shuffled(word, tweak, key)
    step = int.from_bytes(hashlib.blake2b(f"{tweak}|{row[0]}".encode(), key=key, digest_size=8).digest()) % (len(row) - 1) + 1
    return row[(row.index(word) + step) % len(row)]


def _candidates(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    """Rows with personal data: place, text, spans."""
    maybe = pc.fill_null(pc.match_substring_regex(column, MAYBE), False)
    for i in pc.indices_nonzero(maybe).to_pylist():
        text = column[i].as_py()
        if spans := find(text):
            yield i, text, spans


def values(docs: DataFrame) -> DataFrame:
    """kind, value: the distinct personal data of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(kind, text[s:e]) for _, text, spans in _candidates(batch.column(0)) for s, e, kind in spans})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"]
            )

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def redrawn(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, attempt: the values whose first surrogate is not theirs alone, or is a value of the corpus."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, attempt = (c.to_pylist() for c in batch.columns)
            made = [surrogate(*x, key) for x in zip(kind, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "made"])

    found = stage(found, "values")
    drawn = lambda df: df.mapInArrow(draw, "kind string, value string, attempt int, made string")
    now = stage(drawn(found.withColumn("attempt", F.lit(0))), "drawn")
    for turn in range(ROUNDS):
        known = found.select("kind", F.col("value").alias("made"), F.lit(True).alias("real"))
        # of the values that share a surrogate the first keeps it
        first = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = now.join(first, ["kind", "made"]).join(known, ["kind", "made"], "left")
        clash = (F.struct("attempt", "value") != F.col("first")) | (F.col("made") == F.col("value"))
        if turn < AVOID:
            clash = clash | F.col("real").isNotNull()
        judged = stage(judged.select("kind", "value", "attempt", "made", clash.alias("clash")), "judged")
        if not judged.filter("clash").limit(1).count():
            break
        again = drawn(judged.filter("clash").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        now = stage(judged.filter("NOT clash").drop("clash").unionByName(again), "drawn")
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def replace(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The rows of docs with surrogates in their texts, and n_replaced (int; 0 for a null text)."""
    odd = stage(redrawn(values(docs), key), "redrawn")
    columns = docs.columns
    if odd.count() <= shared.BROADCAST_ROWS:
        again = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in odd.collect()})
        given, attempts = docs, None
    else:  # too many to send to every task: each text gets its own
        again, attempts = None, "_attempts"

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), k, text[s:e]) for i, text, spans in _candidates(batch.column(1)) for s, e, k in spans]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], ["_text", "kind", "value"])

        of_text = docs.select(F.sha2("text", 256).alias("h"), "text").mapInArrow(spread, "_text string, kind string, value string").distinct()
        maps = of_text.join(odd, ["kind", "value"]).groupBy("_text").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias(attempts)
        )
        given = docs.join(maps, F.sha2("text", 256) == F.col("_text"), "left").drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            count = [0] * len(texts)
            for i, text, spans in _candidates(batch.column(at)):
                if again is not None:
                    attempt = lambda k, v: again.value.get((k, v), 0)
                else:
                    own = dict(batch.column(batch.schema.get_field_index(attempts))[i].as_py() or [])
                    attempt = lambda k, v, own=own: own.get(f"{k}|{v}", 0)
                out, last = [], 0
                for s, e, kind in spans:
                    out += [text[last:s], surrogate(kind, text[s:e], attempt(kind, text[s:e]), key)]
                    last = e
                texts[i] = "".join(out) + text[last:]
                count[i] = len(spans)
            arrays = [batch.column(batch.schema.get_field_index(c)) if c != "text" else pa.array(texts, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int32())], [*columns, "n_replaced"])

    return given.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_replaced", T.IntegerType())]))
