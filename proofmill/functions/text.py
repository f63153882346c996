"""Text expressions, built only from Catalyst functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill import fixed_values as fv
from proofmill.functions.frames import stage

# Every character the semantics count as white space (ASCII plus Unicode spaces).
SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"[\x{4e00}-\x{9fff}]"


def ascii_word(pattern: str, flags: str = "") -> str:
    """`pattern` between ASCII word boundaries (Java's own \\b is Unicode-aware)."""
    return rf"{flags}(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def trimmed(c: Column) -> Column:
    """White space stripped at both ends; a character-set trim looks at the ends only."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapsed(c: Column) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return F.trim(F.regexp_replace(c, rf"{SPACES}+", " "))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"[^\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def normalize_text(c: Column) -> Column:
    """Split camel case, lower-case, keep ASCII alphanumerics and CJK, collapse."""
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " ")
    return F.trim(c)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def contains_normalized(haystack: Column, needle: Column) -> Column:
    """Phrase containment for two already normalised columns."""
    padded = F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))
    return (needle != "") & F.when(has_cjk(needle), F.contains(haystack, needle)).otherwise(padded)


def contains_term(text: Column, term: Column) -> Column:
    return contains_normalized(normalize_text(text), normalize_text(term))


def with_terms_held(df: DataFrame, text: str, terms: dict[str, str]) -> DataFrame:
    """One boolean column per name: whether the text holds that term (`contains_term`); a text is normalised once for all of them."""
    held = [contains_normalized(F.col("_norm"), normalize_text(F.lit(term))).alias(name) for name, term in terms.items()]
    return stage(df, _norm=normalize_text(F.col(text))).select(*df.columns, *held)


def tokens(normalized: Column) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def meaningful_terms(text: Column, language: Column | None = None, ecosystem: Column | None = None,
                     stop: list[str] | None = None) -> Column:
    """Content tokens in order, repeats kept; preference words are excluded."""
    stop_words = F.split(F.lit(" ".join(stop or fv.GENERIC_WORDS)), " ")
    prefs = F.lit("")
    for pref in (language, ecosystem):
        if pref is not None:
            prefs = F.concat_ws(" ", prefs, F.coalesce(pref, F.lit("")))
    excluded = F.split(normalize_text(prefs), " ")
    return F.filter(
        F.split(normalize_text(text), " "),
        lambda t: (F.length(t) >= F.when(has_cjk(t), 2).otherwise(3))
        & ~F.array_contains(stop_words, t) & ~F.array_contains(excluded, t),
    )


def plain_search_term(c: Column, maximum: int = 100) -> Column:
    kept = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} +_-]+", " "), " +", " "))
    return F.trim(F.substring(kept, 1, maximum))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility folding; Catalyst has no equivalent, so Arrow batches."""
    return values.str.normalize("NFKC")


def bounded_summary(c: Column, limit: int = 320, trim_cut: bool = False) -> Column:
    flat = collapsed(c)
    cut = F.substring(flat, 1, limit - 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.rtrim(cut) if trim_cut else cut, F.lit("…")))


def encode_segment(c: Column) -> Column:
    """Percent-encoding of one path segment (space is %20; ``*'()!~`` stay literal)."""
    out = F.url_encode(c)
    for code, char in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, char)
    return out


def source_url(base: Column, revision: Column, path: Column,
               start: Column | None = None, end: Column | None = None) -> Column:
    encoded = F.array_join(F.transform(F.split(path, "/"), encode_segment), "/")
    url = F.concat(base, F.lit("/blob/"), encode_segment(revision), F.lit("/"), encoded)
    if start is None:
        return url
    return F.concat(url, F.lit("#L"), start.cast("string"), F.lit("-L"), (start if end is None else end).cast("string"))


def line_anchor(url: Column) -> Column:
    """``#L12`` / ``#L12-L20`` as struct(start_line, end_line); NULL lines when absent."""
    pattern = r"#L(\d+)(?:-L?(\d+))?$"
    start = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    end = F.nullif(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.struct(start.cast("long").alias("start_line"), F.coalesce(end, start).cast("long").alias("end_line"))


def stable_id(*parts: Column) -> Column:
    joined = F.concat_ws("\u0000", *[p.cast("string") for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def section_id(section: Column, *parts: Column) -> Column:
    snake = F.lower(F.regexp_replace(section, "([A-Z])", "_$1"))
    return F.concat(F.lit("bp_"), snake, F.lit("_"), stable_id(*parts))


def lf(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def lines(c: Column) -> Column:
    return F.split(lf(c), "\n")


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    items = [F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs]
    return F.array_compact(F.array(*items))


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double: 0.7 -> '0.7', 1.0 -> '1'."""
    return F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")


def style_color(c: Column) -> Column:
    """Channels and black-ness of a CSS colour as a struct."""
    v = F.lower(trimmed(c))
    short, long_ = r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", r"^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})(?:ff)?$"
    rgb = r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})(?:\s*,\s*(1(?:\.0)?))?\s*\)$"

    def channel(i: int) -> Column:
        part = F.regexp_extract(v, short, i)
        return (F.when(v.rlike(short), F.conv(F.concat(part, part), 16, 10))
                .when(v.rlike(long_), F.conv(F.regexp_extract(v, long_, i), 16, 10))
                .when(v.rlike(rgb), F.regexp_extract(v, rgb, i))).cast("long")

    r, g, b = channel(1), channel(2), channel(3)
    hsl_black = r"^(?:hsl\(\s*)?0(?:deg)?[ ,]+0%[ ,]+0%(?:\s*/\s*100%)?\s*\)?$"
    light = r"^(?:hsl\(\s*)?\d+(?:\.\d+)?(?:deg)?[ ,]+\d+(?:\.\d+)?%[ ,]+(\d+(?:\.\d+)?)%"
    pure = F.coalesce((v == "black") | F.coalesce((r == 0) & (g == 0) & (b == 0), F.lit(False)) | v.rlike(hsl_black),
                      F.lit(False))
    lightness = F.nullif(F.regexp_extract(v, light, 1), F.lit("")).cast("double")
    near = ~pure & F.when(r.isNotNull(), F.greatest(r, g, b) <= 24).otherwise(F.coalesce(lightness <= 8, F.lit(False)))
    return F.struct(r.alias("red"), g.alias("green"), b.alias("blue"), pure.alias("pure_black"), near.alias("near_black"))
