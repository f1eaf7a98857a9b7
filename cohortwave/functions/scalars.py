"""Scalar expressions. Every function takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task-name, domain and description words of each category, first match wins.
TASK_CATEGORIES = [
    ("Memory",
     ["memor", "recall", "sequence", "next_in_seq"],
     ["memory"],
     []),
    ("Emotional",
     ["image", "happy", "sad", "angry"],
     ["emotion"],
     []),
    ("Cognitive_Language",
     ["prefrontal", "reading", "sentence", "words", "saying"],
     ["language", "speech", "verbal fluency", "semantic"],
     ["reading", "speech", "language", "verbal"]),
    ("Visual_Spatial",
     ["valdo", "occipital", "parietal", "imagine", "2d_3d", "text_element"],
     ["visual", "spatial", "pattern recognition"],
     ["visual", "spatial", "navigation", "imagery"]),
    ("Motor_Action",
     ["gyrus_left_open", "gyrus_right_open", "gyrus_coord", "gyrus_pause"],
     ["motor", "coordination", "proprioception", "bimanual"],
     ["motor", "movement", "coordination", "proprioception"]),
    ("Auditory",
     ["instruments"],
     ["auditory"],
     ["auditory", "listening", "sound", "music"]),
]
OTHER_CATEGORY = "Other_Stimuli"

# Task-name prefix -> family, first match wins.
BASELINE_TASK = "baseline_talk"
TASK_FAMILIES = [
    (BASELINE_TASK, "baseline"),
    ("frontal", "frontal"),
    ("gyrus", "gyrus"),
    ("image", "image"),
    ("imagine", "imagine"),
    ("occipital", "occipital"),
    ("parietal", "parietal"),
    ("prefrontal", "prefrontal"),
    ("saying_words", "verbal"),
    ("temporal", "temporal"),
    ("valdo", "valdo"),
]

# Label edges and names, left-closed.
HOUR_EDGES = [0.0, 6.0, 8.0, 99.0]
HOUR_LABELS = ["Short", "Normal", "Long"]
FRIENDLY_LABELS = {
    "Short": "Short sleeper (under 6h)",
    "Long": "Long sleeper (over 8h)",
    "Normal": "Normal sleeper (6–8h)",
}
GENDER_CODES = {"M": 0, "F": 1}


def clean_key(c: Column, upper: bool = False) -> Column:
    c = F.trim(c.cast("string"))
    return F.upper(c) if upper else F.lower(c)


def segment_key(task: Column, subject: Column, index: Column | None = None) -> Column:
    parts = [task.cast("string"), subject.cast("string")]
    if index is not None:
        parts.append(F.concat(F.lit("window"), index.cast("string")))
    return F.concat_ws("-", *parts)


def split_feature(name: Column) -> tuple[Column, Column]:
    """Channel and band of a dotted feature name such as ``POW.AF3.Theta``."""
    parts = F.split(name, r"\.")
    return F.get(parts, F.lit(1)), F.get(parts, F.lit(2))


def _contains_any(text: Column, words: list[str]) -> Column:
    # plain substring tests are several times quicker on long texts than one pattern of them all
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def keyword_category(name: Column, description: Column, domain: Column,
                     rules: list = TASK_CATEGORIES, other: str = OTHER_CATEGORY) -> Column:
    """First rule with a word in the name, the domain or the description."""
    def lower(c: Column) -> Column:
        return F.lower(F.coalesce(c.cast("string"), F.lit("")))

    def first_rule(t: Column) -> Column:
        case = None
        for category, in_name, in_domain, in_description in rules:
            hit = (_contains_any(t["name"], in_name) | _contains_any(t["domain"], in_domain)
                   | _contains_any(t["description"], in_description))
            case = F.when(hit, category) if case is None else case.when(hit, category)
        return case.otherwise(other)

    # a lambda's argument is computed once, where branches of a case would each lower the texts anew
    texts = F.struct(lower(name).alias("name"), lower(domain).alias("domain"), lower(description).alias("description"))
    return F.get(F.transform(F.array(texts), first_rule), F.lit(0))


def task_family(task: Column, families: list = TASK_FAMILIES, baseline: str = BASELINE_TASK) -> Column:
    """Family by prefix; the baseline task matches as a whole name only."""
    case = F.when(task == baseline, "baseline")
    for prefix, family in families:
        if prefix != baseline:
            case = case.when(task.startswith(prefix), family)
    return case.otherwise("other")


def bin_label(x: Column, edges: list[float] = HOUR_EDGES, labels: list[str] = HOUR_LABELS) -> Column:
    """Left-closed bins; values outside every bin are missing."""
    case = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (x >= low) & (x < high)
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case


def bin_label_inclusive(x: Column, low: float = 6.0, high: float = 8.0,
                        labels: list[str] = HOUR_LABELS) -> Column:
    """Both cut points belong to the middle class; a missing value falls there too, as NaN does."""
    return F.when(x < low, labels[0]).when(x > high, labels[2]).otherwise(labels[1])


def two_way_label(x: Column, cut: float, side: str, yes, no) -> Column:
    """``yes`` where ``x <side> cut``, else ``no``; side is one of < <= > >=."""
    test = {"<": x < cut, "<=": x <= cut, ">": x > cut, ">=": x >= cut}[side]
    return F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def code_map(c: Column, codes: dict, default=None) -> Column:
    case = None
    for value, code in codes.items():
        case = F.when(c == value, code) if case is None else case.when(c == value, code)
    return case if default is None else case.otherwise(default)


def row_mean(*cols: str) -> Column:
    """Mean over the named columns, missing ones left out; missing when all are."""
    cells = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells).cast("double"))


def safe_name(task: Column) -> Column:
    return F.replace(task, F.lit(" "), F.lit("_"))


def strip_affix(name: Column, prefix: str = "PM.", suffix: str = ".Scaled") -> Column:
    return F.regexp_replace(name, f"^{re.escape(prefix)}|{re.escape(suffix)}$", "")


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; missing for a constant column or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_double(c: Column) -> Column:
    """Text or number to double; what is no number becomes missing."""
    return nan_to_null(c.try_cast("double"))
