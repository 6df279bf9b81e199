"""Text kernels: Column -> Column, no Python at run time."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What text layers emit, and what stands for it.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
SINGLE = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\xa0": " ", "\u202f": " ", "\u2009": " "}
DELETED = "\u200b"

#: Words that mark a language, in order of preference at a tie.
LANGUAGE_MARKERS = {
    "cs": ["faktura", "dph", "částka", "splatnost", "odběratel", "dodavatel", "celkem", "účet"],
    "en": ["invoice", "amount", "payment", "total", "due", "supplier", "customer", "account"],
    "de": ["rechnung", "betrag", "zahlung", "gesamt", "fällig", "lieferant", "kunde"],
    "sk": ["faktúra", "suma", "úhrada", "dodávateľ", "odberateľ"],
    "pl": ["faktura", "kwota", "płatność", "razem", "sprzedawca", "nabywca"],
}
#: Keys whose values are never logged.
SENSITIVE = ["password", "hashed_password", "token", "access_token", "refresh_token", "api_key", "apikey", "secret", "jwt_secret", "authorization", "document_text", "text", "raw_text", "content", "extracted_data"]


def _folding() -> tuple[str, str]:
    """One-to-one accent folding for the Latin blocks, derived from the decompositions."""
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base != chr(cp) and not unicodedata.combining(base):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _folding()


def constant_map(pairs: dict) -> Column:
    """A map of constants, parsed in one step."""
    quote = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    return F.expr("map(" + ", ".join(quote(v) for kv in pairs.items() for v in kv) + ")")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: a Column that is used several times is otherwise planned as often."""
    return F.transform(F.array(x), f)[0]


def unless_ascii(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) where x has a character beyond ASCII, else x: translate goes character by character."""
    return bind(x, lambda v: F.when(F.length(v) == F.octet_length(v), v).otherwise(f(v)))


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def clean_text(x: Column) -> Column:
    def typographic(v: Column) -> Column:
        v = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), v)
        return F.translate(v, "".join(SINGLE) + DELETED, "".join(SINGLE.values()))

    x = F.regexp_replace(unless_ascii(x, typographic), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def detect_language(x: Column) -> Column:
    sample = F.lower(F.substring(x, 1, 4000))
    scored = []
    for i, (code, markers) in enumerate(LANGUAGE_MARKERS.items()):
        n = reduce(lambda a, b: a + b, (sample.contains(m).cast("int") for m in markers))
        scored.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")))
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] >= 2, best["code"])


def fold_accents(x: Column) -> Column:
    """First base character of each character: the length stays."""
    return unless_ascii(x, lambda v: F.translate(v, _FOLD_FROM, _FOLD_TO))


def _spelled(x: Column) -> Column:
    def beyond(v: Column) -> Column:
        v = F.replace(v, F.lit("ß"), F.lit("ss"))
        return F.translate(reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), v), _FOLD_FROM, _FOLD_TO)

    return unless_ascii(F.lower(x), beyond)


def match_key(x: Column) -> Column:
    """Letters and digits only, accents and case dropped."""
    return F.regexp_replace(_spelled(x), "[^0-9a-z]", "")


def match_tokens(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(_spelled(x), "[^0-9a-z]", " "), " "), lambda t: t != "")


def squeeze(x: Column) -> Column:
    """White space runs to one space, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def fold_ascii(x: Column) -> Column:
    return fold_accents(F.lower(x))


def head_tail(x: Column, limit: int, head: float, marker: str) -> Column:
    """Texts over the limit keep their head and tail around a marker."""
    first = int(limit * head)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, first), F.lit(marker), F.right(x, F.lit(limit - first))))


def classification_sample(x: Column) -> Column:
    return head_tail(x, 4000, 0.7, "\n\n[...]\n\n")


#: Fixed value: stands for what a long text lost.
TRUNCATED = "\n\n[... document truncated for length ...]\n\n"


def model_input(x: Column, marker: str = TRUNCATED) -> Column:
    return head_tail(x, 120_000, 0.75, marker)


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 3)).cast("long")


def shortened(x: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit(mark)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def short_digest(prefix: str, x: Column) -> Column:
    """prefix and the first 32 hex digits of SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(x.cast("binary"), 256), 1, 32))


def hmac_sha256(secret: str, message: Column) -> Column:
    """RFC 2104 for a constant key: two nested digests over the padded key."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(c ^ b for c in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def redact(fields: Column) -> Column:
    """A map with the values of sensitive keys hidden."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), F.lit("[redacted]")).otherwise(v))


def safe_filename(x: Column) -> Column:
    base = F.element_at(F.split(F.translate(x, "\\", "/"), "/"), -1)
    base = F.regexp_replace(base, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    base = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w\s.\-()\[\]]", "_"), r"\A[. ]+|[. ]+\z", "")
    ext = F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise("")
    keep = F.lit(199) - F.length(ext)
    stem = F.when(base.contains("."), F.substring(base, F.lit(1), F.length(base) - F.length(ext) - 1)).otherwise(base)
    cut = F.when((ext != "") & (keep > 0), F.concat(F.substring(stem, F.lit(1), keep), F.lit("."), ext)).otherwise(F.substring(base, 1, 200))
    base = F.when(F.length(base) > 200, cut).otherwise(base)
    return F.when(x.isNull() | (x == "") | (base == ""), "document").otherwise(base)
