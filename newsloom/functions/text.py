"""Text columns: cleaning, tokens, and predicates over tokens.

All are Column expressions that stay inside the JVM, but for HTML, Unicode normalisation and case folding, which
Spark lacks: these are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import html as html_lib
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stopwords of the keyword extractor.
STOPWORDS = (
    "và là của cho với trong một những các được để khi theo từ tại trên vào ra này đó như có không đã sẽ bị do nên mà hay "
    "hoặc rất còn đang thì lại cùng sau trước qua đến về bởi hơn nhất nhiều ít từng mỗi mọi"
).split()

#: Words with inner punctuation between letters or digits.
TOKEN = r"[\p{L}\p{N}_]+(?:[./:&+#-][\p{L}\p{N}_]+)*"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


class _Text(HTMLParser):
    """Collects text outside of script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skipping = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skipping:
            self.skipping -= 1

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)


def html_to_text(value: str | None) -> str:
    """The text of an HTML fragment, its pieces separated by spaces."""
    if not value:
        return ""
    if "<" not in value and "&" not in value:
        return value
    parser = _Text()
    parser.feed(value)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def strip_html(values: pd.Series) -> pd.Series:
    return values.map(html_to_text)


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html_lib.unescape(v))


@F.pandas_udf(StringType())
def normalize_keyword(values: pd.Series) -> pd.Series:
    """NFKC, white space to single spaces, case folded (ß becomes ss, which lower() leaves)."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


@F.pandas_udf(StringType())
def nfc_without_html(values: pd.Series) -> pd.Series:
    """The two steps of clean_text that need Python, in one pass."""
    return values.map(lambda v: html_to_text(unicodedata.normalize("NFC", v)) if v else "")


def remove_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def strip(text: Column) -> Column:
    """Without white space of Unicode at both ends; trim() knows the space only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """NFC, no HTML, no control characters, single spaces; null is empty."""
    return collapse(remove_control(nfc_without_html(F.coalesce(text, F.lit("")))))


def join_text(*parts: Column, separator: str = " ") -> Column:
    """Parts joined, null as empty, without white space at the ends."""
    return strip(F.concat_ws(separator, *(F.coalesce(p, F.lit("")) for p in parts)))


def raw_tokens(text: Column) -> Column:
    """Tokens as written; underscores belong to them."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens as written; underscores and no-break spaces separate them."""
    return raw_tokens(F.translate(text, "_\u00a0", "  "))


# What is taken off the ends of a token, beside white space.
EDGES = ",.;:!?\"'`()[]{}<>“”‘’"


def normalize_token(token: Column) -> Column:
    """In lower case, underscores as spaces, without white space and punctuation at its ends."""
    return F.lower(F.btrim(F.replace(token, F.lit("_"), F.lit(" ")), F.lit(f" \t\r\n{EDGES}")))


def is_blank(text: Column) -> Column:
    """Null, or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def lower_tokens(text: Column) -> Column:
    return F.transform(tokens(text), F.lower)


def is_numeric(token: Column) -> Column:
    return F.regexp_replace(token, "[.,]", "").rlike(r"^\p{Nd}+$")


def has_letters(token: Column) -> Column:
    return token.rlike(r"\p{L}")


def looks_like_entity(token: Column) -> Column:
    """Letters and digits together, or a capital at the start."""
    return has_letters(token) & (token.rlike(r"\p{Nd}") | token.rlike(r"^\p{Lu}"))


def is_stopword(token: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return token.isin(*stopwords)


def model_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """What a classifier sees of a text: lower-cased words that hold a letter or digit and are no stopwords."""
    return F.filter(lower_tokens(text), lambda t: ~F.array_contains(F.array(*map(F.lit, stopwords)), t)) if stopwords else lower_tokens(text)


def is_valid_keyword(phrase: Column, size: Column) -> Column:
    """The last gate before a keyword is kept: size words once normalised, a letter, at most one number, no row of lone numbers."""
    return is_valid_normalized(normalize_keyword(phrase), size)


def is_valid_normalized(keyword: Column, size: Column) -> Column:
    """is_valid_keyword of a normalised phrase; full-width and raised digits are plain ones there, and all of Unicode's digits count."""
    words = F.split(keyword, " ")
    numbers = F.size(F.filter(words, lambda w: w.rlike(r"(?U)^[\d.,]+$")))
    return (keyword != "") & (F.size(words) == size) & has_letters(keyword) & (numbers < 2) & ~keyword.rlike(r"(?U)\b\d+[.,\d]*\s+\S+\s+\d+\s+\d+\b")


def article_text(text: Column) -> Column:
    """Extracted article text with tidy spaces and at most one blank line in a row."""
    t = F.regexp_replace(F.translate(unescape(text), " ", " "), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


# Lines of a podcast page that are no text.
NOISE_LINES = ["Xem bản chép lời", "Bản chép lời", "0:00/0:00"]


def without_noise(text: Column) -> Column:
    """Lines that are neither blank nor noise."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(*NOISE_LINES)), "\n")


def margin_bucket(margin: Column, dash: str = "–") -> Column:
    """The bucket of a decision margin."""
    return (
        F.when(margin < 0.10, "<0.10").when(margin < 0.20, f"0.10{dash}0.20").when(margin < 0.30, f"0.20{dash}0.30")
        .when(margin < 0.50, f"0.30{dash}0.50").otherwise(">=0.50")
    )


def margin_buckets(dash: str = "–") -> list[str]:
    return ["<0.10", f"0.10{dash}0.20", f"0.20{dash}0.30", f"0.30{dash}0.50", ">=0.50"]
