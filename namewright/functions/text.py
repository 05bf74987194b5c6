"""Names as Column functions: normalisation, keys, sets, similarities, signatures. All run inside Spark's JVM but NFKC (udfs.nfkc)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import nfkc

#: Greek letters that dialect n2 spells out.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"}
#: Patterns of lipid shorthand, stereo marks, salt forms and abbreviations.
LIPID_CHAINS = r"(?i)([a-z]{1,8})\s*\(?\s*(\d{1,2})\s*[:/]\s*(\d{1,2})(?:[;_/,-](\d{1,2})\s*[:/]\s*(\d{1,2}))*"
LIPID_FIRST = r"\b([a-z]{1,6})\s*[\( ]?\s*(\d{1,2})\s*:\s*(\d{1,2})\b"
LIPID_CLASSES = r"(?i)\b(?:pc|pe|pg|pi|ps|pa|tg|dg|mg|sm|cer|dhcer|hexcer|lpc|lpe|fa|car|ce)\s*[\( ]?\s*\d{1,2}\s*:\s*\d{1,2}"
STEREO_ANY = r"\b(?:cis|trans|alpha|beta|d|l|r|s|e|z|rac|ent)\b|[()\[\]@+-]"
STEREO_MARKS = r"\b(?:cis|trans|alpha|beta)\b|\b[dl]-|\([+-]\)|\b[0-9]+[rs]\b|\b[0-9]+[ez]\b"
STEREO_LOCANTS = STEREO_MARKS + r"|\([0-9rs,\-]+\)"
SALT_FORMS = r"(?i)\b(?:hydrochloride|chloride|sodium|potassium|calcium|magnesium|ammonium|hydrate|anhydrous|salt|sulfate|sulphate|phosphate|acetate|formate|adduct|oxide|ester|methyl ester|ethyl ester)\b"
ABBREVIATION = r"^[A-Z0-9\-\s]{2,12}$"


def _all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _filled(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def normalize(col: Column, dialect: str = "n1") -> Column:
    """Normalised name; null is empty. n0: NFKC, lower case, single spaces. n1: also minus signs. n2: Greek letters spelled out. n3: ASCII white space only, no NFKC."""
    col = _filled(col)
    if dialect == "n3":
        return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")
    if dialect not in ("n0", "n1", "n2"):
        raise ValueError(f"unknown dialect: {dialect}")
    text = nfkc(col)
    if dialect == "n2":
        for letter, word in GREEK.items():
            text = F.replace(text, F.lit(letter), F.lit(word))
    text = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.translate(text, "−", "-") if dialect == "n1" else text, r"(?U)\s+", " ")


def compact(norm: Column) -> Column:
    return F.regexp_replace(F.lower(norm), "[^a-z0-9]+", "")


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, "[^a-z0-9]+"), lambda t: t != ""))


def char3(norm: Column) -> Column:
    """Character trigrams of the compact key; itself if it has three or fewer."""
    key = compact(norm)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 2, F.lit(1))), lambda i: F.substring(key, i, F.lit(3)))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """both_empty: 0.0 in dialect A, 1.0 in dialect B."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(both_empty))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def lipid_signature_a(norm: Column) -> Column:
    """First chain of every lipid shorthand, joined by pipes."""
    return F.array_join(F.zip_with(_all(norm, LIPID_CHAINS, 2), _all(norm, LIPID_CHAINS, 3), lambda c, d: F.concat(c, F.lit(":"), d)), "|")


def lipid_signature_b(norm: Column) -> Column:
    """(class, carbons, bonds) of the first shorthand, or null."""
    part = [F.regexp_extract(norm, LIPID_FIRST, i) for i in (1, 2, 3)]
    return F.when(norm.rlike(LIPID_FIRST), F.struct(part[0].alias("cls"), part[1].alias("carbons"), part[2].alias("bonds")))


def lipid_class_a(norm: Column) -> Column:
    return F.regexp_extract(norm, r"^([a-z]{1,8})\b", 1)


def stereo_flag(norm: Column) -> Column:
    return norm.rlike(STEREO_ANY)


def stereo_signature(norm: Column) -> Column:
    return F.sort_array(_all(norm, STEREO_MARKS))


def stereo_tokens(norm: Column) -> Column:
    return F.sort_array(F.array_distinct(_all(norm, STEREO_LOCANTS)))


def has_lipid(text: Column) -> Column:
    return text.rlike(LIPID_CLASSES)


def has_salt_form(text: Column) -> Column:
    return text.rlike(SALT_FORMS)


def abbreviation_like(text: Column) -> Column:
    text = F.trim(_filled(text))
    key, toks = compact(text), F.size(tokens(F.lower(text)))
    return (text.rlike(ABBREVIATION) & (F.length(key) <= 12)) | ((toks <= 2) & (F.length(key) <= 10) & key.rlike("[0-9]")) | ((toks == 1) & (F.length(key) <= 8))


def _spaced(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def clean_suffix(norm: Column) -> Column:
    """Without instrument suffixes: bracketed adducts, trailing @/_ and signed numbers, asterisks."""
    for pattern in (r"\[[^\]]*m[^\]]*\]", r"[@_]\s*[-+]?\d+(?:\.\d+)?\s*$", r"\s+[+-]\s*\d+(?:\.\d+)?\s*$", r"\*"):
        norm = F.regexp_replace(norm, pattern, " ")
    return _spaced(norm)


def punctuation_spaced(norm: Column) -> Column:
    return _spaced(F.regexp_replace(clean_suffix(norm), r"[()\[\]{};,/_]+", " "))


#: Methods of name variants, best first; the compact key comes after them.
VARIANTS = ("exact", "strip_instrument_suffix", "punctuation_spaced", "remove_quotes", "remove_terminal_count")


def name_variants(norm: Column) -> Column:
    """Array of (priority, method, value): distinct non-empty variants, each under its first method."""
    values = [norm, clean_suffix(norm), punctuation_spaced(norm), F.regexp_replace(norm, "['\"`]", ""), F.trim(F.regexp_replace(norm, r"(?:\s|_)+\d+$", ""))]
    values = [_spaced(v) for v in values]
    seen, out = [], []
    for i, (method, v) in enumerate(zip(VARIANTS, values, strict=True)):
        new = v != ""
        for w in seen:
            new = new & (v != w)
        out.append(F.when(new, F.struct(F.lit(i).alias("priority"), F.lit(method).alias("method"), v.alias("value"))))
        seen.append(v)
    return F.array_compact(F.array(*out))


def parse_cids(col: Column, separators: str = r"[|;,]\s*", numeric: bool = True) -> Column:
    """Sorted distinct identifiers; null words are none; ``123.0`` is ``123`` if numeric."""
    text = F.trim(_filled(col))
    parts = F.filter(F.transform(F.split(text, separators), lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin("nan", "none", "null"))
    if numeric:
        parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^([0-9]+)\.0$", "$1"))
    return F.sort_array(F.array_distinct(parts))


def cid_string(cids: Column) -> Column:
    return F.array_join(F.sort_array(F.filter(cids, lambda c: c != "")), "|")


def cids_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def size_bucket(n: Column) -> Column:
    """Synonym-set sizes; 1 falls to the last bucket like everything above 20."""
    return F.when(n == 2, "2").when(n.between(3, 5), "3-5").when(n.between(6, 10), "6-10").when(n.between(11, 20), "11-20").otherwise("21+")


BUCKET_ORDER = ("2", "3-5", "6-10", "11-20", "21+")


def quality_score(norm: Column) -> Column:
    """How well a synonym reads as a name; points are fixed values."""
    points = [
        (norm.rlike("^[0-9]+$"), -10),
        (F.length(norm).between(4, 80), 3),
        (norm.rlike("[a-z]"), 2),
        (norm.rlike("[0-9].*[a-z]|[a-z].*[0-9]"), 1),
        (norm.rlike("acid|ate|ine|ol|ose|ide|lipid|phosphate|carnitine|coenzyme|vitamin"), 2),
        (norm.rlike("deprecated|unknown|mixture|unspecified|not available"), -4),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))


def trainable(norm: Column, least: int = 3, most: int = 180, least_key: int = 3) -> Column:
    key = compact(norm)
    return F.length(norm).between(least, most) & (F.length(key) >= least_key) & key.rlike("[a-z]") & ~norm.rlike(r"\[[a-z]{1,8}\]\s*$") & ~norm.rlike("^[a-z]{1,3}$")


def hard_key(text: Column, prefix: int = 4) -> Column:
    """Key prefix and floored length bin."""
    key = compact(text)
    head = F.substring(key, 1, max(prefix, 1))
    return F.struct(F.when(head == "", "<empty>").otherwise(head).alias("prefix"), F.least(F.floor(F.length(key) / 8), F.lit(24)).cast("int").alias("length_bin"))


def hard_key_text(norm: Column, prefix: int = 8) -> Column:
    """Key prefix and length bin as one string; bins round half to even."""
    key = compact(norm)
    return F.concat(F.substring(key, 1, prefix), F.lit("_"), F.least(F.bround(F.length(key) / 8.0).cast("int"), F.lit(32)).cast("string"))


def surface_relation(q: Column, t: Column) -> Column:
    """First that holds: exact_normalized, exact_compact, substring, same_tokens, different."""
    qt, tt = F.sort_array(tokens(q)), F.sort_array(tokens(t))
    return (
        F.when((q != "") & (q == t), "exact_normalized")
        .when((compact(q) != "") & (compact(q) == compact(t)), "exact_compact")
        .when((q != "") & (t != "") & (F.contains(t, q) | F.contains(q, t)), "substring")
        .when((F.size(qt) > 0) & (qt == tt), "same_tokens")
        .otherwise("different")
    )


SUPPORTED = ("exact_normalized", "exact_compact", "same_tokens", "substring")


def partial_relation(a: Column, b: Column, ratio: Column, threshold: float = 0.90, least: int = 5, least_ratio: float = 0.5) -> Column:
    """Relation of trimmed lower-case surfaces; ``ratio`` is their sequence ratio. Null ratios are allowed where an earlier case holds."""
    ka, kb = compact(a), compact(b)
    short, long = F.least(F.length(ka), F.length(kb)), F.greatest(F.length(ka), F.length(kb))
    ta, tb = tokens(a), tokens(b)
    common = F.size(F.array_intersect(ta, tb))
    return (
        F.when((a == "") | (b == ""), "missing_surface")
        .when(a == b, "exact_normalized_equal")
        .when((ka != "") & (ka == kb), "compact_equal")
        .when((short >= least) & (short >= least_ratio * long) & (F.contains(kb, ka) | F.contains(ka, kb)), "compact_substring")
        .when(ratio >= threshold, f"seq_ratio_ge_{threshold:.2f}")
        .when((F.least(F.size(ta), F.size(tb)) >= 2) & (common == F.least(F.size(ta), F.size(tb))), "token_subset")
        .otherwise("nontrivial_surface_difference")
    )


def strong_alias(a: Column, b: Column, ratio: Column) -> Column:
    """a, b in dialect n2; ratio: their sequence ratio."""
    ka, kb = compact(a), compact(b)
    tok, ch = jaccard(tokens(a), tokens(b), 1.0), jaccard(char3(a), char3(b), 1.0)
    return (a == b) | ((ka != "") & (ka == kb) & (F.length(ka) >= 5)) | (ratio >= 0.96) | ((ratio >= 0.90) & (tok >= 0.80)) | ((ch >= 0.92) & (tok >= 0.70))


def as_bool(col: Column) -> Column:
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1", "yes"), F.lit(False))


def as_rank(col: Column) -> Column:
    """Number, or null for not found (text, NaN, infinity)."""
    x = col.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])
