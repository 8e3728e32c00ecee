"""String functions.  Built-in expressions where the semantics allow, Arrow functions for Unicode forms."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Small kana and the large ones they are folded to for matching.
SMALL_KANA = "ぁぃぅぇぉゃゅょっァィゥェォャュョッ"
LARGE_KANA = "あいうえおやゆよつアイウエオヤユヨツ"
# The Latin letters of the sample tables and their ASCII forms.
LATIN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ASCII = "ACEEEINOOUsaceeeinoou"
# Characters that subtitle markup would interpret, and their full-width forms.
MARKUP = "\\{}"
FULL_WIDTH = "＼｛｝"
DEFAULT_SPEAKER = "マネージャー"
USER_TAG = "{user}"

@cache
def _dropped(fold_kana: bool) -> dict[int, int | None]:
    """A translation table without white space and punctuation (Unicode category P); small kana become large if asked for."""
    table: dict[int, int | None] = {
        i: None for i, c in enumerate(map(chr, range(sys.maxunicode + 1))) if c.isspace() or unicodedata.category(c)[0] == "P"
    }
    return table | (str.maketrans(SMALL_KANA, LARGE_KANA) if fold_kana else {})


def bare(text: str) -> str:
    """NFKC without white space and punctuation."""
    return unicodedata.normalize("NFKC", text).translate(_dropped(False))


def match_form(text: str) -> str:
    """The form in which readings and script lines are compared."""
    plain = text.replace(r"\N", "").replace(r"\n", "")
    return unicodedata.normalize("NFKC", plain).translate(_dropped(True))


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(match_form, na_action="ignore")


@F.pandas_udf(StringType())
def text_key(texts: pd.Series) -> pd.Series:
    return texts.map(bare, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_ascii(text: Column) -> Column:
    return F.translate(text, LATIN, ASCII)


def ascii_match_form(text: Column) -> Column:
    """``match_form`` for text of Latin letters, in built-in expressions: folded, lower case, letters and digits."""
    plain = F.replace(F.replace(text, F.lit(r"\N"), F.lit("")), F.lit(r"\n"), F.lit(""))
    return F.lower(F.regexp_replace(fold_ascii(plain), "[^A-Za-z0-9]", ""))


def similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when((F.length(left) == 0) | (F.length(right) == 0), F.lit(0.0)).otherwise(
        1 - F.levenshtein(left, right).cast("double") / longest
    )


def same_text(left: Column, right: Column) -> Column:
    return left == right


def escape_markup(text: Column) -> Column:
    """Text that is not to be read as markup: full-width forms first, then line ends as ``\\N``."""
    return F.regexp_replace(F.translate(text, MARKUP, FULL_WIDTH), r"\r\n|\r|\n", r"\\N")


def file_name(title: Column) -> Column:
    """A title as a file name."""
    return F.replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" "), F.lit("_"))


def with_player(text: Column, player: str = "") -> Column:
    return F.replace(text, F.lit(USER_TAG), F.lit(player.strip() or DEFAULT_SPEAKER))


def is_usable_text(key: Column, text: Column) -> Column:
    """At least two characters of key and one letter."""
    return (F.length(key) >= 2) & text.rlike(r"\p{L}")
