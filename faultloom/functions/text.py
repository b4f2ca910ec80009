"""Text and token expressions. All are column expressions but for Unicode folding, which only non-ASCII rows reach."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a line: the separators a text reader knows, not only the line feed.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def sha16(x: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(x, 256), 1, 16)


def strip(x: Column) -> Column:
    """Outer whitespace of any kind removed."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have none, and a final line end starts no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and standing in the plan, once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def keep(items: Column, condition) -> Column:
    """Entries of an array that meet a condition; a null array is empty."""
    return F.coalesce(F.filter(items, condition), no_strings())


def unique_keep_order(items: Column, limit: int = 32) -> Column:
    """Trimmed non-blank entries, each at its first place, at most ``limit``."""
    return F.slice(F.array_distinct(keep(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def first_position(items: Column, condition) -> Column:
    """1-based place of the first entry that meets a condition, 0 if none does."""
    return F.array_position(F.transform(items, lambda x: F.coalesce(condition(x), F.lit(False))), True)


def canon_func(x: Column) -> Column:
    """A function name without its offset and without the suffixes compilers add, each taken off once in this order."""
    name = F.substring_index(F.regexp_replace(strip(x), r"\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+", ""), "+", 1)
    for suffix in ("cold", "isra", "constprop", "part", "llvm"):
        name = F.regexp_replace(name, rf"\.{suffix}(?:\.\d+)?$", "")
    return strip(name)


def _fold(text: str | None) -> str | None:
    """Compatibility-folded ASCII text; arrows are set apart before other characters are dropped."""
    if text is None or text.isascii():
        return text
    folded = unicodedata.normalize("NFKC", text.replace("\ufffd", ""))
    return folded.replace("->", " -> ").encode("ascii", "ignore").decode("ascii")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [_fold(x) for x in xs])


def _ascii(x: Column) -> Column:
    return x.rlike(r"^\p{ASCII}*$")


def fold_text(x: Column) -> Column:
    """A text folded to ASCII if it has other characters; ASCII texts stay in built-in expressions and only nulls reach Python for them."""
    return F.when(_ascii(x), x).otherwise(_folded(F.when(~_ascii(x), x)))


def fold_list(xs: Column) -> Column:
    """`fold_text` for every entry of an array: whole arrays go to Python, as array functions cannot call it, and only those that have any such entry."""
    foreign = F.coalesce(F.exists(xs, lambda t: ~_ascii(t)), F.lit(False))
    return F.when(foreign, _folded_list(F.when(foreign, xs))).otherwise(xs)


def ascii_clean(x: Column, fold: bool = True) -> Column:
    """Compatibility-folded ASCII text with ``->`` set apart and blanks collapsed; null gives an empty text.

    ``fold=False`` is for texts that have been folded already, as for use inside array functions.
    """
    text = F.replace(fold_text(x) if fold else x, F.lit("->"), F.lit(" -> "))
    return F.coalesce(F.trim(F.regexp_replace(text, r"[\s\x00\x0b\x1c-\x1f]+", " ")), F.lit(""))


def canonical_token(x: Column, fold: bool = True) -> Column:
    """A token in lower case with underscores for blanks, ``->`` for arrows and ``.`` for ``::``, outer `` _.,;`` dropped."""
    text = F.replace(F.lower(ascii_clean(x, fold)), F.lit(" -> "), F.lit("->"))
    text = F.replace(F.replace(text, F.lit("=>"), F.lit("->")), F.lit("::"), F.lit("."))
    return F.regexp_replace(F.regexp_replace(text, r"[\s_]+", "_"), r"^[ _.,;]+|[ _.,;]+$", "")


def token_to_words(token: Column, fold: bool = True) -> Column:
    """A canonical token as blank-separated words."""
    text = F.replace(F.replace(canonical_token(token, fold), F.lit(":"), F.lit(" ")), F.lit("->"), F.lit("."))
    text = F.regexp_replace(F.regexp_replace(text, "[\\[\\]{}<>\"'`]", " "), r"[_/\\|,;]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ordered_unique(values: Column, fold: bool = True) -> Column:
    """Canonical tokens of an array, empty ones dropped, each at its first place; null gives an empty array."""
    texts = fold_list(values) if fold else values
    return F.array_distinct(keep(F.transform(texts, lambda t: canonical_token(t, False)), lambda t: t != ""))


def compact_sentence(label: str, x: Column, fold: bool = True) -> Column:
    """``label: text``, or an empty text if there is none."""
    text = ascii_clean(x, fold)
    return F.when(text != "", F.concat(F.lit(f"{label}: "), text)).otherwise("")


def clean_token(x: Column) -> Column:
    """Lower-case token of letters, digits and ``:-./>[]``, anything else as single underscores; null gives an empty text."""
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", "_"), r"[^a-z0-9_:\-./>\[\]]+", "_")
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", ""), F.lit(""))


def capped(text: Column, most: int, note: str = "\n[truncated]") -> Column:
    """At most ``most`` characters with a note where cut; ``most`` of 0 or less means no limit."""
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(note))).otherwise(text)


def format_field(name: str, tokens: Column, fold: bool = True) -> Column:
    """The text of a field for embedding: its name, then a line per token with its words where they differ."""
    def line(t: Column) -> Column:
        token, words = canonical_token(t, False), token_to_words(t, False)
        return F.concat(F.lit("token: "), token, F.when((words != "") & (words != token), F.concat(F.lit(" ; words: "), words)).otherwise(""))

    return F.when(F.size(tokens) > 0, F.concat(F.lit(f"[{name}]\n"), F.array_join(F.transform(fold_list(tokens) if fold else tokens, line), "\n"))).otherwise("")


def non_blank(*values: Column) -> Column:
    """First text that is not null or blank, as it stands."""
    return F.coalesce(*[F.when(strip(v) != "", v) for v in values])


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression on the path's end: ``*`` and ``?`` stay within a name, ``**/`` spans folders."""
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"(?:^|/){out}$"


#: POSIX character classes and what they stand for.
POSIX_CLASSES = {"space": r"\s", "blank": r" \t", "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "digit": "0-9", "upper": "A-Z", "lower": "a-z", "xdigit": "0-9a-fA-F"}


def java_pattern(pattern: str) -> str:
    """A pattern with POSIX classes as one for the engine's regular expressions."""
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX_CLASSES.get(m.group(1), m.group(0)), pattern)
