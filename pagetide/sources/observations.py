"""Page observations: one row per response."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions.gates import is_json
from pagetide.functions.urls import url_key

OBSERVATION = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("observed_at", T.TimestampNTZType()),
    ]
)


def as_observations(raw: DataFrame) -> DataFrame:
    """Add the registry key and the JSON flag; `page_url` keeps the url as requested."""
    return raw.select(
        "seq",
        url_key(F.col("url")).alias("url"),
        F.col("url").alias("page_url"),
        "body",
        F.col("status").cast("int").alias("status"),
        "observed_at",
        is_json(F.col("content_type"), F.col("url")).alias("is_json"),
    )


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejects with a reason). A failed request has no body and never reaches the registry."""
    reason = F.when(F.col("url").isNull(), "no url").when(F.col("body").isNull(), "no body")
    usable = raw.filter("url IS NOT NULL AND body IS NOT NULL")
    rejects = raw.filter("url IS NULL OR body IS NULL").select("seq", "url", reason.alias("reason"))
    return usable, rejects


def pages_as_observations(pages: DataFrame, observed_at: str, content_type: str = "text/html", status: int = 200) -> DataFrame:
    """A table pages(page_id, url, html) as observations made at one time."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("seq"),
        "url",
        F.col("html").alias("body"),
        F.lit(content_type).alias("content_type"),
        F.lit(status).alias("status"),
        F.lit(observed_at).cast("timestamp_ntz").alias("observed_at"),
    )


# --- bytes to text -------------------------------------------------------------------------------------------

BOMS = (("efbbbf", "utf-8"), ("fffe", "utf-16le"), ("feff", "utf-16be"))
KANA = 0.2  # share of kana among the letters beyond ASCII from which on a text counts as Japanese
_CHARSET = r"(?i)charset=\s*[\"']?\s*([^\s;\"'/>]+)"


def _guess(raw: bytes) -> str:
    """Charset of bytes that are no plain UTF-8 text, from their values and places."""
    half = len(raw) // 2
    for at, name in ((1, "utf-16le"), (0, "utf-16be")):  # zeros in at least half of the upper bytes
        if half and 2 * raw[at::2].count(0) >= half:
            return name
    if b"\x1b$" in raw:
        return "iso-2022-jp"
    for name in ("euc_jp", "cp932"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        beyond = [c for c in text if c > "\x7f"]
        if sum("\u3040" <= c <= "\u30ff" for c in beyond) > KANA * len(beyond):
            return name
    return "windows-1252"


@F.arrow_udf(T.StringType())
def _guess_all(body: pa.Array) -> pa.Array:
    return pa.array([None if raw is None else _guess(raw) for raw in body.to_pylist()], type=pa.string())


def marked_charset(body: Column) -> Column:
    """Charset that a byte order mark names, or NULL."""
    start = F.lower(F.hex(F.substring(body, 1, 3)))
    return F.coalesce(*(F.when(F.startswith(start, F.lit(mark)), name) for mark, name in BOMS))


def guessed_charset(body: Column) -> Column:
    """Charset by statistics of the bytes. UTF-8 without zeros and escapes stays in the JVM; the rest needs one Arrow stage."""
    view = F.decode(body, "ISO-8859-1")
    plain = F.is_valid_utf8(body.cast("string")) & ~view.contains("\x00") & ~view.contains("\x1b$")
    return F.when(plain, "utf-8").otherwise(_guess_all(F.when(~plain, body)))


def charset(
    content_type: Column, url: Column, body: Column, detected: Column | None = None, guessed: Column | None = None
) -> Column:
    """Charset name of a response: detected, then header, then meta charset, then http-equiv, then guessed, then utf-8."""
    some = lambda c: F.when(c != "", F.lower(c))
    ascii_view = F.decode(body, "ISO-8859-1")
    header = some(F.regexp_extract(content_type, _CHARSET, 1))
    meta = some(F.regexp_extract(ascii_view, r"(?is)<meta\s+(?:[^>]*\s)?charset\s*=\s*[\"']?\s*([^\s;\"'/>]+)", 1))
    equiv_tag = F.regexp_extract(
        ascii_view, r"(?is)(<meta\s[^>]*http-equiv\s*=\s*[\"']?content-type[\"']?[^>]*>)", 1
    )
    equiv = some(F.regexp_extract(equiv_tag, _CHARSET, 1))
    from_page = F.when(~is_json(content_type, url), F.coalesce(meta, equiv))
    found = [some(detected)] if detected is not None else []
    return F.coalesce(*found, header, from_page, *([guessed] if guessed is not None else []), F.lit("utf-8"))


@F.arrow_udf(T.StringType())
def _decode_any(body: pa.Array, name: pa.Array) -> pa.Array:
    def text(raw, label):
        if raw is None:
            return None
        try:
            codecs.lookup(label)
        except LookupError:
            label = "utf-8"
        return raw.decode(label, errors="replace")

    return pa.array(map(text, body.to_pylist(), name.to_pylist()), type=pa.string())


def decode_body(body: Column, charset_name: Column) -> Column:
    """Text of a response body. UTF-8 stays in the JVM; other charsets go through one Arrow stage."""
    utf8 = charset_name.isin("utf-8", "utf8", "us-ascii", "ascii")
    return F.coalesce(
        F.when(utf8, F.make_valid_utf8(body.cast("string"))),
        _decode_any(F.when(~utf8, body), charset_name),
    )


def with_text_bodies(raw: DataFrame) -> DataFrame:
    """Bodies as text. Bytes are decoded by byte order mark, header, tags of the page and statistics, in this order.

    Bytes that do not fit their charset become replacement characters, an unknown charset is read as UTF-8, and a byte
    order mark is no part of the text. A table whose bodies are text already is returned as it is.
    """
    if not isinstance(raw.schema["body"].dataType, T.BinaryType):
        return raw
    body = F.col("body")
    declared = charset(F.col("content_type"), F.col("url"), body, marked_charset(body), F.lit(""))
    named = raw.withColumn("_charset", F.nullif(declared, F.lit("")))
    guess = guessed_charset(F.when(F.col("_charset").isNull(), body))
    text = F.regexp_replace(decode_body(body, F.coalesce("_charset", guess)), "^\ufeff", "")
    return named.withColumn("body", text).drop("_charset")
