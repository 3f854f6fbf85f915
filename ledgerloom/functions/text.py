"""Text functions as Spark columns; Python only where Spark has no function of the same meaning."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The white space that counts, whatever the engine's own tables say.
WHITE_SPACE = r"[\x09-\x0d\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = re.compile(WHITE_SPACE + "+")
_ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())
#: What counts as an address of mail or a telephone number in text that is made public.
EMAIL = r"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"
PHONE = r"(?<![A-Za-z0-9_])(?:\+?[0-9][0-9 .()\-]{7,}[0-9])(?![A-Za-z0-9_])"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
BIDI = r"[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"


def collapse_white_space(text: Column) -> Column:
    """Runs of white space become one space, none is left at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE + "+", " "))


def strip_white_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


@F.arrow_udf(StringType())
def _nfkc(batch: pa.Array) -> pa.Array:
    normalise = unicodedata.ucd_3_2_0.normalize
    return pa.array([None if x is None else normalise("NFKC", x) for x in batch.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _unescape(batch: pa.Array) -> pa.Array:
    return pa.array([None if x is None else html.unescape(x) for x in batch.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility normal form by the pinned Unicode 3.2 tables; ASCII stays in the JVM."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*+$")
    return F.coalesce(_nfkc(F.when(~ascii_only, text)), text)


def html_unescape(text: Column) -> Column:
    """HTML entities decoded; text without an ampersand stays in the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def normalise(text: Column) -> Column:
    return collapse_white_space(nfkc(text))


def label(text: Column) -> Column:
    """The form in which labels are compared."""
    return ascii_lower(normalise(text))


def platform(text: Column) -> Column:
    """A platform's one name."""
    name = label(text)
    return F.when(name == "hn", "hackernews").otherwise(name)


def label_of(text: str) -> str:
    """label() of one string on the driver or in a batch."""
    return _SPACES.sub(" ", unicodedata.ucd_3_2_0.normalize("NFKC", text)).strip(" ").translate(_ASCII_LOWER)


def platform_of(text: str) -> str:
    """platform() of one string."""
    name = label_of(text)
    return "hackernews" if name == "hn" else name


def duplicate_text_key(text: Column) -> Column:
    """Texts of one key are the same text: compatibility form, white space as one space, then entities decoded, ASCII lower case."""
    return ascii_lower(html_unescape(normalise(text)))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a text without any."""
    flat = collapse_white_space(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def sha256_tag(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def opaque_id(size: int, *parts: Column) -> Column:
    """The first `size` hex digits of the hash of the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(cell.rlike(rf"^(?:[\x00-\x20]|{WHITE_SPACE})*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def ratio_points(actual: Column, target: Column) -> Column:
    """10 points for a target that is reached, in proportion below it."""
    return F.least(F.lit(1.0), actual / target) * 10


def word_grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` words of a text in lower case, [] for a shorter text."""
    words = F.split(F.lower(collapse_white_space(text)), " ")
    # the words go through a lambda of their own: a lambda evaluates what it takes from outside anew for each element
    runs = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " ")))
    enough = F.coalesce((F.length(collapse_white_space(text)) > 0) & (F.size(words) >= size), F.lit(False))
    return F.when(enough, F.array_distinct(F.element_at(runs, 1))).otherwise(F.array().cast("array<string>"))


def identifier_parts(text: Column) -> Column:
    """All runs of twelve or more lower-case letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{12,}"), F.lit(0)))
