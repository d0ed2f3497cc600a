"""Column functions on file names, sample ids and compound names."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Greek letters after NFKC, by their Unicode names; Unicode writes LAMDA and names the final sigma apart.
GREEK = {
    chr(c): {"LAMDA": "LAMBDA"}.get(word, word)
    for c in (*range(0x391, 0x3AA), *range(0x3B1, 0x3CA))
    if (name := unicodedata.name(chr(c), "")) and (word := name.rsplit(" ", 1)[-1])
}


def base_name(c: Column) -> Column:
    """The last part of a path with either slash."""
    return F.regexp_replace(c, r"^.*[\\/]", "")


def file_stem(c: Column) -> Column:
    """The base name up to ``.raw`` and up to a blank and parenthesis."""
    return F.trim(F.regexp_replace(F.regexp_replace(base_name(c), r"\.raw.*$", ""), r" \(.*$", ""))


def clean_name(c: Column) -> Column:
    """The stem without one trailing replicate number 1 or 2."""
    return F.regexp_replace(file_stem(c), "_[12]$", "")


def clean_name_keep_qc(c: Column, as_written: bool = False) -> Column:
    """As ``clean_name``, but expQC files keep their number; as written, ``_1`` and ``_2`` go wherever they stand."""
    stem = file_stem(c)
    cut = F.replace(F.replace(stem, F.lit("_1"), F.lit("")), F.lit("_2"), F.lit("")) if as_written else F.regexp_replace(stem, "_[12]$", "")
    return F.when(F.lower(stem).contains("expqc"), stem).otherwise(cut)


def batch_of(c: Column, unknown: str = "UNKNOWN") -> Column:
    """Letters, number and running number of the batch in a file name."""
    name = base_name(c)
    tries = [F.nullif(F.regexp_extract(name, p + r"([A-Z]+\d+_\d+)", 1), F.lit("")) for p in ("posneg_", "Posneg_", "")]
    return F.coalesce(*tries, F.lit(unknown))


def sample_of(c: Column) -> Column:
    """The sample id in a column header ``Area: <file>.raw (F<n>)``; NULL without the prefix."""
    rest = F.split_part(c, F.lit("Area: "), F.lit(2))
    stem = F.trim(F.split_part(F.trim(F.split_part(rest, F.lit(" ("), F.lit(1))), F.lit(".raw"), F.lit(1)))
    return F.when(c.contains("Area: "), F.trim(F.regexp_replace(stem, "_[12]$", "")))


def sample_type_of(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("expqc"), "QC").when(low.contains("blanco"), "blanco").when(low.contains("blauw"), "blauw").when(low.contains("mix"), "Mix").otherwise("Sample")


def numeric_id(c: Column) -> Column:
    """The last part between underscores that is all digits, else the last part."""
    p = F.split(c, "_")
    return F.coalesce(F.try_element_at(F.filter(p, lambda x: x.rlike("^[0-9]+$")), F.lit(-1)), F.element_at(p, -1))


def strip_area(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^Area:\s*", ""), r"(?i)\.raw$", "")


def feature_key_parts(c: Column) -> dict[str, Column]:
    """Base, retention time and number of a key ``<base>_<rt>[ <n>]``; failures give 0.0 and '1'."""
    n = F.nullif(F.regexp_extract(c, r" (\d+)$", 1), F.lit(""))
    rest = F.when(n.isNotNull(), F.regexp_replace(c, r" \d+$", "")).otherwise(c)
    return {
        "base": F.when(rest.contains("_"), F.regexp_extract(rest, r"^(.*)_[^_]*$", 1)).otherwise(rest),
        "rt": F.coalesce(F.regexp_extract(rest, r"_([^_]*)$", 1).try_cast("double"), F.lit(0.0)),
        "n": F.coalesce(n, F.lit("1")),
    }


def _normal(s: object) -> str | None:
    if s is None or s != s:
        return None
    t = unicodedata.normalize("NFKC", str(s).removeprefix("﻿"))
    return "".join(GREEK.get(ch, ch) for ch in t)


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    """Compatibility forms and Greek letters as words; the JVM has no function for the former."""
    return s.map(_normal)


def normal_name(c: Column) -> Column:
    """Names compared exactly: compatibility forms, Greek letters as words, W between digits as OMEGA, trimmed, upper case."""
    t = F.regexp_replace(_compatible(c), r"(?i)(?<=\d)W(?=\d)", "OMEGA")
    # Upper case folds spelled-out Greek words as well, so they need no list of their own.
    return F.upper(F.regexp_replace(t, r"^\s+|\s+$", ""))


def loose_name(c: Column) -> Column:
    return F.regexp_replace(normal_name(c), "[^A-Z0-9]+", "")


def accession_tag(normal: Column) -> Column:
    """An accession that is the whole name or stands behind its last dot."""
    return F.nullif(F.regexp_extract(normal, r"(?:^|\.)(HMDB[0-9]{3,})$", 1), F.lit(""))


def split_outside(c: Column, separator: str = ";") -> Column:
    """Parts between separators that aren't inside one level of brackets; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, separator + r"(?![^(\[]*[)\]])"), lambda x: F.trim(x)), lambda x: x != "")


def marker_direction(c: Column) -> Column:
    return F.when(c.contains("↑"), "up").when(c.contains("↓"), "down").otherwise("")


def marker_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[↑↓*]", ""), r"\s+", " "))


def plain_pathway(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\(PathBank PW\d+\)\s*$", ""))


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("disease"))


def truth(c: Column) -> Column:
    """Booleans from booleans, numbers or words; anything else is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "1.0", "yes"), F.lit(False))


def header_role(headers: Sequence[str], roles: dict[str, Sequence[str]]) -> dict[str, str]:
    """The header of each role: case and underscores don't matter, a role's names are prefixes, the first header wins."""
    plain = {h: " ".join(h.replace("_", " ").lower().split()) for h in headers}
    return {r: h for r, names in roles.items() if (h := next((h for n in names for h in headers if plain[h].startswith(n.lower())), None))}


def contains_any(c: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    hay = F.lower(c) if ignore_case else c
    out = F.lit(False)
    for p in patterns:
        out = out | hay.contains(p.lower() if ignore_case else p)
    return F.coalesce(out, F.lit(False))


def is_qc_union(sample_id: Column, sample_type: Column, pattern: str, fallback: str | None) -> Column:
    """Case-sensitive: typed as QC, or either pattern in the id."""
    return F.coalesce(sample_type == "QC", F.lit(False)) | contains_any(sample_id, [p for p in (pattern, fallback) if p], ignore_case=False)


def is_qc_fold(original: Column, sample_type: Column, pattern: str, fallback: str | None) -> Column:
    """Case-insensitive form on the column header."""
    return F.coalesce(F.lower(sample_type) == "qc", F.lit(False)) | contains_any(original, [p for p in (pattern, fallback) if p])


def group_code(sample_id: Column) -> Column:
    low = F.lower(sample_id)
    return F.when(low.contains("qc3") & ~low.contains("expqc_3"), 1).when(low.contains("qc4"), 2).otherwise(0)
