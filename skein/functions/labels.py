"""Label functions, as Column builders: three normal forms, tokens, similarity, families, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that belong together, by family.
SOFA_LABELS = ("couch", "sofa", "loveseat")
SOFA_LABELS_WIDE = ("couch", "sofa", "loveseat", "arm sofa")
PERSON_LABELS = ("person", "woman", "man", "human")

_STRIP = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any sort at its ends; trim() would leave tabs and line ends."""
    return F.regexp_replace(x, _STRIP, "")


def plain(x: Column) -> Column:
    """Stripped, lower case, underscores as blanks; null as the empty string. Inner blanks stay as they are."""
    return F.replace(F.lower(strip(F.coalesce(x, F.lit("")))), F.lit("_"), F.lit(" "))


def collapsed(x: Column) -> Column:
    """plain, with each run of white space as one blank and none at the ends."""
    return strip(F.regexp_replace(plain(x), r"(?U)\s+", " "))


def without_article(x: Column) -> Column:
    """collapsed, without a leading a, an or the."""
    return F.regexp_replace(collapsed(x), r"^(a|an|the)\s+", "")


def tokens(label: Column) -> Column:
    """Distinct words of a normal label; a word of over three letters in -s adds itself without the s."""
    words = F.filter(F.split(label, " "), lambda w: w != "")
    both = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(both))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays without repeats, as a part of all; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def similarity(a: Column, b: Column, given: Column) -> Column:
    """Of two normal labels: the given one clipped to 0..1, else 1 if equal, 0.8 if one holds the other, 0.35..0.75 by shared tokens, or 0.2."""
    j = jaccard(tokens(a), tokens(b))
    return (
        F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0)))
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.8)
        .when(j > 0, F.greatest(F.lit(0.35), F.least(F.lit(0.75), j)))
        .otherwise(0.2)
    )


def family_wide(label: Column) -> Column:
    """chair, sofa, table, computer, person or null."""
    return (
        F.when(_any(label, ("chair",)) | (label == "stool"), "chair")
        .when(label.isin(*SOFA_LABELS_WIDE), "sofa")
        .when(_any(label, ("table", "desk")), "table")
        .when(_any(label, ("computer", "laptop", "monitor")), "computer")
        .when(label.isin(*PERSON_LABELS), "person")
    )


def family(label: Column) -> Column:
    """The three families that merging tells apart: chair, table, sofa; else null."""
    return (
        F.when(_any(label, ("chair",)) | (label == "stool"), "chair")
        .when(_any(label, ("table", "desk")), "table")
        .when(label.isin(*SOFA_LABELS), "sofa")
    )


def _any(label: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(label, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(label, F.lit(p))
    return found


def compatible(a: Column, b: Column) -> Column:
    """Equal, one within the other, a token in common, or of one family."""
    return (a == b) | F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(tokens(a), tokens(b)) | F.coalesce(family_wide(a) == family_wide(b), F.lit(False))


def more_specific(a: Column, b: Column) -> Column:
    """The label whose words include all of the other's and more, else the one of more words, else null."""
    wa, wb = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (a, b))
    inside = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(x) < F.size(y))
    return F.when((a == "") | (b == "") | (a == b), F.lit(None)).when(inside(wa, wb), b).when(inside(wb, wa), a).when(F.size(wa) > F.size(wb), a).when(F.size(wa) < F.size(wb), b)


def pair_key(a: Column, b: Column) -> Column:
    """One key for both orders of two labels."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def slug(x: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends; `object` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", "object").otherwise(s)


def frame_number(stem: Column) -> Column:
    """The number that a frame's name ends in, or null."""
    return F.regexp_extract(stem, r"([0-9]+)$", 1).try_cast("bigint")


def split_tags(x: Column) -> Column:
    """Parts between bars, commas, semicolons and line ends, stripped, without empty ones."""
    parts = F.transform(F.split(x, r"[|,;\n]"), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def clean_tags(raw: Column, most: int, least_chars: int) -> Column:
    """Normal tags without short and all-digit ones, each once in first order, at most `most`."""
    normal = F.transform(raw, lambda t: without_article(t))
    kept = F.filter(normal, lambda t: (F.length(t) >= least_chars) & ~t.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, most)
