"""Unicode properties of single characters, for tables of distinct characters (at most the size of Unicode).

Properties form a dimension table that is computed for a whole column at once: category, name and script first, then
the groups, painted over each other from the general to the special.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Retained letters of the refined vocabulary and the kana ranges.
GREEK = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρστυφχψως"
RUSSIAN_EXTRA = "Ёё"
KANA_RANGES = ((0x3041, 0x3096), (0x3099, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF61, 0xFF9F))
JAPANESE_MARKS = "々〆〇〻〼"
SPACES = " 　"
# Group, status and what belongs to it (categories, script, ranges or characters). A later row takes
# characters from an earlier one.
GROUPS = (
    ("other_script_or_number", "review", {}),
    ("combining_mark", "review", {"category": "Mn Mc Me"}),
    ("extended_latin", "review", {"script": "latin"}),
    ("other_punctuation_and_symbols", "review", {"category": "Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So"}),
    ("cjk_punctuation_and_symbols", "candidate", {"category": "Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So", "ranges": ((0x3000, 0x303F),)}),
    ("fullwidth_alphanumeric_and_symbols", "candidate", {"ranges": ((0xFF01, 0xFF60), (0xFFE0, 0xFFE6))}),
    ("japanese_iteration_and_marks", "candidate", {"characters": JAPANESE_MARKS}),
    ("kana", "candidate", {"script": "kana"}),
    ("han", "candidate", {"script": "han"}),
    ("ascii", "candidate", {"ranges": ((0x21, 0x7E),)}),
    ("other_space", "review", {"category": "Zs"}),
    ("space", "candidate", {"characters": SPACES}),
    ("control_private_or_unassigned", "exclude", {"category": "Cc Cf Cs Zl Zp"}),
    ("control_private_or_unassigned", "review", {"category": "Co Cn"}),
    ("variation_selector", "exclude_standalone", {"ranges": ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))}),
)
_SCRIPTS = {"han": r"^CJK (?:UNIFIED|COMPATIBILITY) IDEOGRAPH-", "kana": "HIRAGANA|KATAKANA", "latin": "LATIN", "greek": "GREEK"}


def _inside(code: np.ndarray, ranges) -> np.ndarray:
    return np.logical_or.reduce([(code >= a) & (code <= b) for a, b in ranges])


def dimension(chars: pd.Series) -> pd.DataFrame:
    """Properties of a column of single characters; null where a value is null or not one character."""
    one = chars.map(lambda c: isinstance(c, str) and len(c) == 1).astype(bool)
    c = chars[one]
    code = c.map(ord).to_numpy(np.int64) if len(c) else np.zeros(0, np.int64)
    out = pd.DataFrame({"category": c.map(unicodedata.category), "name": c.map(lambda x: unicodedata.name(x, ""))}, index=c.index, dtype=object)
    category, script = out["category"], {name: out["name"].str.contains(pattern, regex=True).to_numpy(bool) if len(c) else np.zeros(0, bool) for name, pattern in _SCRIPTS.items()}
    out["group"] = out["status"] = None
    for group, status, what in GROUPS:
        held = np.ones(len(c), bool)
        if "category" in what:
            held &= category.isin(what["category"].split()).to_numpy()
        if "script" in what:
            held &= script[what["script"]]
        if "ranges" in what:
            held &= _inside(code, what["ranges"])
        if "characters" in what:
            held &= c.isin(list(what["characters"])).to_numpy()
        out.loc[held, ["group", "status"]] = [group, status]
    out["class"] = category.where(~script["han"], "han")
    refined = pd.Series("other_digits_symbols_spaces", index=c.index, dtype=object)
    letter = category.str.startswith("L").to_numpy(bool) if len(c) else np.zeros(0, bool)
    for name, held in (
        ("han", (out["group"] == "han").to_numpy()),
        ("modern_kana_and_marks", _inside(code, KANA_RANGES) & (category != "Cn").to_numpy()),
        ("cyrillic_russian_basic", ((code >= 0x410) & (code < 0x450)) | c.isin(list(RUSSIAN_EXTRA)).to_numpy()),
        ("greek_basic", c.isin(list(GREEK)).to_numpy()),
        ("latin_iso8859_1", (code < 256) & (script["latin"] & letter | c.isin(["ª", "º"]).to_numpy())),
    ):
        refined[held] = name
    out["refined_group"] = refined
    # What a script's letters must belong to in order to stay; these groups stay whatever their script.
    out["removal_reason"] = None
    free = out["group"].isin(["ascii", "space", "cjk_punctuation_and_symbols", "japanese_iteration_and_marks"]).to_numpy()
    for kind, home, reason in (("kana", "modern_kana_and_marks", "outside_modern_kana_ranges"), ("greek", "greek_basic", "outside_basic_greek"), ("latin", "latin_iso8859_1", "outside_iso8859_1_latin")):
        out.loc[script[kind] & (refined != home).to_numpy() & ~free, "removal_reason"] = reason
    return out.reindex(chars.index).astype(object).where(lambda x: x.notna(), None)


_PROPERTIES = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "name", "group", "status", "class", "refined_group", "removal_reason")])


@F.pandas_udf(_PROPERTIES)
def _properties(chars: pd.Series) -> pd.DataFrame:
    return dimension(chars)[_PROPERTIES.names]


def with_properties(df: DataFrame, column: str = "character") -> DataFrame:
    """df plus category, name, group, status, class, refined_group and removal_reason of its characters.

    For tables of distinct characters; null for null and for strings of other than one character.
    """
    return df.withColumn("p", _properties(F.col(column))).select(*df.columns, "p.*")


@F.pandas_udf(T.StringType())
def normalised(text: pd.Series, form: pd.Series) -> pd.Series:
    """The text in a Unicode normal form (NFC, NFD, NFKC or NFKD); Spark has no such function. Null stays null."""
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)], dtype=object)
