"""Names, ids and numbers taken out of free text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _latin_folding() -> tuple[str, str]:
    """Source and target letters for ``translate``: every Latin letter that decomposes into one ASCII letter
    plus marks, and the two Turkish i forms that no decomposition covers."""
    source, target = ["ı"], ["i"]
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            source.append(chr(cp))
            target.append("i" if chr(cp) == "İ" else base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _latin_folding()


def fold_latin(text: Column) -> Column:
    """Latin letters without their accents; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_name_key(name: Column) -> Column:
    """Comparison key of a personal name: accents folded, lower case, punctuation and ``_`` become spaces."""
    t = F.lower(fold_latin(F.coalesce(name, F.lit(""))))
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]|_+", " "))


@F.pandas_udf(T.StringType())
def normalize_name_key_unicode(names: pd.Series) -> pd.Series:
    """The same key with full compatibility decomposition, for names outside the Latin script."""

    def key(name):
        if not name:
            return ""
        plain = unicodedata.normalize("NFKD", name.replace("ı", "i").replace("İ", "i"))
        plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isalnum() else " " for c in plain).split())

    return names.map(key, na_action=None)


def slugify(text: Column, fallback: str = "unknown") -> Column:
    """The name key in ``a-z0-9`` and single dashes. Each step reads the one before once: Spark would derive again what a condition and
    its branch both name. Word characters beyond ASCII leave no gap, all others are one."""
    t = F.lower(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[[^\x00-\x7F]&&[\w]]+", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.btrim(t, F.lit("-")), "^$", fallback)


def build_driver_id(name: Column) -> Column:
    return F.concat(F.lit("drv_"), slugify(name))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def build_stage_id(rally_id: Column, stage_number: Column) -> Column:
    """``{rally}_ss{n}``; a stage number inside text is found, a missing part gives NULL."""
    number = F.coalesce(stage_number.try_cast("int"), first_number(stage_number.cast("string")))
    rally = F.nullif(F.trim(rally_id.cast("string")), F.lit(""))
    return F.concat(rally, F.lit("_ss"), number.cast("string"))


def numeric_prefix(text: Column) -> Column:
    """Leading integer of a text id, 0 when there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def ascii_upper_name(name: Column) -> Column:
    t = F.translate(F.upper(F.trim(name)), "İĞÜŞÖÇ", "IGUSOC")
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "BILINMEYEN").otherwise(t)


def _turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def _turkish_upper(text: Column) -> Column:
    return F.upper(F.translate(text, "iı", "İI"))


def turkish_title(name: Column) -> Column:
    """Title case with the Turkish dotted and dotless i."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    cased = F.transform(
        words,
        lambda w: F.concat(_turkish_upper(F.substring(w, 1, 1)), _turkish_lower(F.substr(w, F.lit(2)))),
    )
    return F.when(F.coalesce(name, F.lit("")) == "", name).otherwise(F.array_join(cased, " "))


def length_from_name(text: Column) -> Column:
    """Kilometres named in a stage title such as ``8,25km``."""
    return F.replace(F.regexp_extract(text, r"(?i)(\d+[,.]?\d*)\s*km", 1), F.lit(","), F.lit(".")).try_cast("double")


# The stage-number patterns, tried in this order.
STAGE_NUMBER_PATTERNS = [
    r"(?iU)\bsss\s*0*(\d+)\b",
    r"(?iU)\bss\s*0*(\d+)\b",
    r"(?iU)\b[öo]e\s*0*(\d+)\b",
    r"(?iU)\b[öo]\.\s*e\.?\s*0*(\d+)\b",
    r"(?iU)\betap\s*0*(\d+)\b",
    r"(?iU)\bstage\s*0*(\d+)\b",
    r"(?iU)\b(\d+)\.\s*etap\b",
]
STAGE_ID_PATTERNS = [r"(?i)_ss0*(\d+)\b", r"(?i)\bss\s*0*(\d+)\b", r"(\d+)$"]
FILE_NAME_PATTERNS = [r"[Ss][Ss](\d+)", r"(?i)stage[_-]?(\d+)"]
HEADER_PATTERNS = [r"(?iu)(?:ÖE|SS)\s*(\d+)"]
DAY_PATTERNS = [r"(?iu)(\d+)\.\s*g[uü]n", r"(?iu)day[- ]?(\d+)", r"(?iu)g[uü]n[- ]?(\d+)"]


def first_match(text: Column, patterns: list[str]) -> Column:
    """Number found by the first pattern that matches."""
    return F.coalesce(*[F.regexp_extract(text, p, 1).try_cast("int") for p in patterns])


def stage_number_from_text(text: Column) -> Column:
    return first_match(text, STAGE_NUMBER_PATTERNS)


def stage_number_from_id(text: Column) -> Column:
    return first_match(text, STAGE_ID_PATTERNS)


def stage_number_from_file(text: Column) -> Column:
    return first_match(text, FILE_NAME_PATTERNS)


def stage_number_from_header(text: Column) -> Column:
    return first_match(text, HEADER_PATTERNS)


def day_number(text: Column) -> Column:
    return first_match(text, DAY_PATTERNS)


def year_from_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit(""))


def event_id_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/yaris/(\d+)", 1).try_cast("int")


def stage_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"[?&]etp=(\d+)", 1).try_cast("int")


def day_from_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"gun(\d+)", 1).try_cast("int"), F.lit(1))


# Event-name clean-up, applied in this order to the lower-cased name.
EVENT_NAME_RULES = [
    (r"(?U)\d{4}", ""),
    (r"(?iU)rallisi?", "rally"),
    (r"(?iU)günü?|gun|day", ""),
    (r"(?U)\d+\.\s*", ""),
    (r"[_\-\+]+", " "),
    (r"(?U)\s+", " "),
    (r"(?i)\.kml|\.kmz", ""),
]


def normalize_event_name(name: Column) -> Column:
    t = F.trim(F.lower(name))
    for pattern, replacement in EVENT_NAME_RULES:
        t = F.regexp_replace(t, pattern, replacement)
    return F.trim(t)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger word count; NULL when a side has no word."""
    wa, wb = word_set(a), word_set(b)
    return F.try_divide(
        F.size(F.array_intersect(wa, wb)).cast("double"),
        F.when((F.size(wa) > 0) & (F.size(wb) > 0), F.greatest(F.size(wa), F.size(wb))),
    )


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (``difflib``); edit distance is not the same measure."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def similarity(a_normalized: Column, b_normalized: Column) -> Column:
    """Mean of the sequence ratio and the keyword overlap of two normalised names."""
    ratio = sequence_ratio(a_normalized, b_normalized)
    overlap = keyword_overlap(a_normalized, b_normalized)
    return F.when(overlap.isNull(), ratio).otherwise((ratio + overlap) / 2)


def missing_if(col: Column, *sentinels) -> Column:
    """NULL where the value is one of the given stand-ins for "not known"."""
    return F.when(~col.isin(*sentinels), col)


def to_number(text: Column) -> Column:
    t = F.trim(text.cast("string"))
    return F.when(~t.isin("", "unknown"), t.try_cast("double"))


def clean_text(text: Column) -> Column:
    return F.nullif(F.trim(text.cast("string")), F.lit(""))
