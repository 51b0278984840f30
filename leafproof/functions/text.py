"""Column functions over text, labels and identifiers. All native but `tok_udf`, which is for ingest only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: The URL namespace of name-based UUIDs (RFC 9562), as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Crockford's base 32 digits.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def tok(text: str) -> list[str]:
    """Tokens of a string on the driver: NFKC, runs of letters and digits, lower-cased."""
    return [t.lower() for t in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text))]


@F.pandas_udf(ST.ArrayType(ST.StringType()))
def tok_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """`tok` for texts outside NFKC form, to be run once when pages are written."""
    for b in batches:
        yield b.map(lambda t: [] if t is None else tok(t))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order; null text gives none. Equals `tok` on NFKC text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens_at_write(text: Column) -> Column:
    """`tokens` where the text is ASCII, `tok_udf` elsewhere."""
    return F.when(F.length(text) == F.octet_length(text), tokens(text)).otherwise(tok_udf(text))


def padded(words: Column) -> Column:
    """Tokens as one string with a space around each: phrase search is then a substring search."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def normal(text: Column) -> Column:
    return padded(tokens(text))


def variants(label: Column) -> Column:
    """Spellings of a label: spaces collapsed; without spaces; letters and digits set apart. First occurrences."""
    one = F.trim(F.regexp_replace(label, r"\s+", " "))
    bare = F.regexp_replace(label, r"\s+", "")
    apart = F.regexp_replace(F.regexp_replace(bare, r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2")
    return F.filter(F.array_distinct(F.array(one, bare, apart)), lambda v: v != "")


def printed(norm: Column, label: Column) -> Column:
    """Whether any spelling of the label is a phrase of the padded text. A label without tokens is never printed."""
    return F.exists(variants(label), lambda v: (F.size(tokens(v)) > 0) & norm.contains(normal(v)))


def is_code(token: Column) -> Column:
    return token.rlike(r"\p{N}")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def numbered(n: Column) -> Column:
    """At least three digits."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def page_id(doc: Column, revision: Column, page_no: Column) -> Column:
    return F.concat(doc, F.lit("@"), revision, F.lit("#p"), numbered(page_no))


def parse_page_id(pid: Column) -> tuple[Column, Column, Column, Column]:
    """(doc_id, revision, page_no, canonical); others than canonical spellings have nulls."""
    pattern = r"^([^@#]+)@([^@#]+)#p([0-9]+)$"
    no = F.regexp_extract(pid, pattern, 3)
    ok = pid.rlike(pattern) & (no.rlike("^[0-9]{3}$") | no.rlike("^[1-9][0-9]{3,}$")) & (no != "000")
    part = lambda k: F.when(ok, F.regexp_extract(pid, pattern, k))
    return part(1), part(2), part(3).cast("int"), ok


def section_id(doc: Column, revision: Column, ordinal: Column) -> Column:
    return F.concat(doc, F.lit("@"), revision, F.lit("#s"), numbered(ordinal))


def series_id(doc: Column, key: Column) -> Column:
    return F.concat(doc, F.lit("#s:"), F.lower(slug(key)))


def uuid5(name: Column) -> Column:
    """The name-based UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def ulid(ms: Column, entropy_hex: Column) -> Column:
    """A ULID of a millisecond stamp and 20 hex digits of entropy."""
    bits = F.concat(F.lpad(F.conv(ms.cast("string"), 10, 2), 50, "0"), *[F.lpad(F.conv(F.substring(entropy_hex, 1 + 5 * k, 5), 16, 2), 20, "0") for k in range(4)])
    digit = lambda k: F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(k) for k in range(26)])


def claim_key(text: Column) -> Column:
    return F.array_join(tokens(text), "")


def cache_key(*parts: Column) -> Column:
    """sha256 of the parts, each with its length before it."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def caller(token: Column) -> Column:
    return F.concat(F.lit("caller:"), F.substring(F.sha2(token, 256), 1, 12))


def mutations(token: Column, alphabet: str = "0123456789abcdefghijklmnopqrstuvwxyz") -> Column:
    """Every one-character substitution as (fake, position, nth): by character, positions from the last back."""
    spots = F.reverse(F.sequence(F.lit(1), F.length(token)))
    letters = F.array(*[F.lit(c) for c in alphabet])
    every = F.flatten(F.transform(letters, lambda c: F.transform(spots, lambda p: F.struct(c.alias("c"), p.alias("p")))))
    other = F.filter(every, lambda m: F.substring(token, m["p"], F.lit(1)) != m["c"])
    return F.transform(other, lambda m, k: F.struct(F.overlay(token, m["c"], m["p"]).alias("fake"), (m["p"] - 1).alias("position"), (k + 1).alias("nth")))
