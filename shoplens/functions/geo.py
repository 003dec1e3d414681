"""Geo labels: localized name pick and the region relabel rules.

The relabel rules are data (two small tables); defaults equal the service's rules. The
code table applies only under country 'UA'; the stems apply under any country, first
match in list order wins; a hit sets the country to 'RU'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: canonical subject labels --------------------------------------------
SUBJ_CRIMEA = "Республика Крым"
SUBJ_SEVASTOPOL = "Севастополь"
SUBJ_DONETSK = "ДНР (Донецкая обл.)"
SUBJ_LUHANSK = "ЛНР (Луганская обл.)"
SUBJ_ZAPORIZHZHIA = "Запорожская обл."
SUBJ_KHERSON = "Херсонская обл."

# --- fixed values: subdivision code -> subject (country 'UA' only) ------------------------
RELABEL_CODES = {
    "43": SUBJ_CRIMEA,
    "40": SUBJ_SEVASTOPOL,
    "14": SUBJ_DONETSK,
    "09": SUBJ_LUHANSK,
    "23": SUBJ_ZAPORIZHZHIA,
    "65": SUBJ_KHERSON,
}

# --- fixed values: lower-case stems in match order -> subject ------------------------------
RELABEL_STEMS = (
    ("crimea", SUBJ_CRIMEA),
    ("krym", SUBJ_CRIMEA),
    ("крым", SUBJ_CRIMEA),
    ("sevastopol", SUBJ_SEVASTOPOL),
    ("sebastopol", SUBJ_SEVASTOPOL),
    ("севастопол", SUBJ_SEVASTOPOL),
    ("donetsk", SUBJ_DONETSK),
    ("донецк", SUBJ_DONETSK),
    ("luhansk", SUBJ_LUHANSK),
    ("lugansk", SUBJ_LUHANSK),
    ("луганск", SUBJ_LUHANSK),
    ("zaporizh", SUBJ_ZAPORIZHZHIA),
    ("zaporozh", SUBJ_ZAPORIZHZHIA),
    ("запорож", SUBJ_ZAPORIZHZHIA),
    ("kherson", SUBJ_KHERSON),
    ("херсон", SUBJ_KHERSON),
)

# --- fixed values: preferred name languages ----------------------------------------------
NAME_LANGS = ("ru", "en")


def pick_name(names) -> Column:
    """ru, then en, then any non-empty value (deterministic: the smallest)."""
    m = F.col(names) if isinstance(names, str) else names
    picks = [F.nullif(F.try_element_at(m, F.lit(lang)), F.lit("")) for lang in NAME_LANGS]
    rest = F.array_min(F.filter(F.map_values(m), lambda v: v.isNotNull() & (v != "")))
    return F.coalesce(*picks, rest)


def _code_expr(subj_iso: Column, codes: dict[str, str]) -> Column:
    e = None
    for code, subj in codes.items():
        e = (F.when(subj_iso == code, F.lit(subj)) if e is None
             else e.when(subj_iso == code, F.lit(subj)))
    return e


def _stem_expr(subject: Column, stems) -> Column:
    low = F.lower(subject)
    e = None
    for stem, subj in stems:
        e = (F.when(low.contains(stem), F.lit(subj)) if e is None
             else e.when(low.contains(stem), F.lit(subj)))
    return e


def region_relabel(country, subject, subj_iso, codes: dict[str, str] | None = None,
                   stems=None) -> tuple[Column, Column]:
    """(country, subject) after the relabel rules; unchanged when no rule fires."""
    c = F.col(country) if isinstance(country, str) else country
    s = F.col(subject) if isinstance(subject, str) else subject
    iso = F.col(subj_iso) if isinstance(subj_iso, str) else subj_iso
    by_code = F.when(c == "UA", _code_expr(iso, codes or RELABEL_CODES))
    by_stem = F.when(s.isNotNull() & (s != ""), _stem_expr(s, stems or RELABEL_STEMS))
    new_subject = F.coalesce(by_code, by_stem)
    return (F.when(new_subject.isNotNull(), F.lit("RU")).otherwise(c),
            F.coalesce(new_subject, s))
