"""Labels of gene-set terms and programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Collection prefixes and abbreviations that keep their capitals.
PREFIXES = ("GOBP", "GOCC", "GOMF", "KEGG", "REACTOME", "HALLMARK", "WP", "BIOCARTA")
CAPITALS = ("DNA", "RNA", "ATP", "GTP", "NADH", "MHC", "TGF", "TNF", "IL", "NF", "ER", "MAPK", "PI3K", "JAK", "STAT", "WNT", "BMP", "EGFR", "VEGF")


def clean_term(term: Column) -> Column:
    """Without collection prefix, GO number and direction suffix; words apart, adjacent repeats once, first letter large, known abbreviations and Roman numerals in capitals."""
    out = F.regexp_replace(term, rf"^({'|'.join(PREFIXES)})_", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\(GO:\d+\)$", ""), r"(?i)[_ ](up|dn|down)$", "")
    words = F.filter(F.split(F.lower(F.replace(out, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != "")
    once = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == w), acc).otherwise(F.concat(acc, F.array(w))))
    known = F.transform(once, lambda w: F.when(F.upper(w).isin(*CAPITALS) | w.rlike("^(ii|iii|iv|vi|vii|viii|ix)$"), F.upper(w)).otherwise(w))
    text = F.array_join(known, " ")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def program_label(name: Column) -> Column:
    """Trailing digits of a program's name, else the name."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("P"), digits)).otherwise(name)


def parse_overlap(text: Column) -> Column:
    """'k/n' as a share."""
    parts = F.split(text, "/")
    return F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))
