"""Column functions over names, tokens and rewritten text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two or more word characters, as the lexical index counts them.
TERM = r"[\p{L}\p{N}_]{2,}"
#: What a rewrite must leave as it is: numbers with separators and percent signs, then upper-case codes with a digit.
NUMBER = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]+)?%?"
CODE = r"[A-Z]{2,}[0-9][A-Z0-9\-]*"


def terms(text: Column) -> Column:
    """The lower-cased terms of a text, in order and with repeats; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at either end, of any kind and not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exact_tokens(text: Column) -> Column:
    """The distinct numbers, percentages and codes of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{NUMBER}|{CODE}"), F.lit(0))))


def lost_tokens(raw: Column, rewritten: Column) -> Column:
    """Exact tokens of ``raw`` that ``rewritten`` lacks; additions and multiplicity don't matter."""
    return F.array_except(exact_tokens(raw), exact_tokens(rewritten))


def guarded(raw: Column, rewritten: Column) -> Column:
    """The rewrite if there is one and it kept every exact token, else the raw text."""
    blank = F.coalesce(stripped(raw) == "", F.lit(True))
    return F.when(~blank & rewritten.isNotNull() & (F.size(lost_tokens(raw, rewritten)) == 0), rewritten).otherwise(raw)


def name_tokens(name: Column) -> Column:
    """Blank-separated tokens of a trimmed, lower-cased name; double blanks make empty tokens."""
    return F.split(F.lower(F.trim(name)), " ")


def sorted_name(name: Column) -> Column:
    """The tokens in order, so that word order doesn't matter."""
    return F.array_join(F.sort_array(name_tokens(name)), " ")


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edits by the longer length; null for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b).cast("double") / F.nullif(longest, F.lit(0)).cast("double")


def token_similarity(a: Column, b: Column) -> Column:
    """Distinct shared tokens by all tokens of both less the shared; repeats count below the line only."""
    shared = F.size(F.array_intersect(a, b))
    return shared.cast("double") / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)).cast("double")


def variant_lines(answer: Column, most: int) -> Column:
    """The first ``most`` non-blank lines of a paraphraser's answer without bullets; a bare bullet is an empty variant."""
    lines = F.filter(F.split(answer, "\n"), lambda x: stripped(x) != "")
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[- ]+|[- ]+$", "")), 1, most)


def confirmed(answer: Column, prefix: str = "YA") -> Column:
    """Whether a verifier's answer begins with the affirmative."""
    return F.startswith(F.upper(stripped(answer)), F.lit(prefix))


def file_name(path: Column) -> Column:
    """The last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def source_label(base: Column, path: Column) -> Column:
    return F.format_string("[%s] %s", F.coalesce(base, F.lit("unknown")), file_name(F.coalesce(path, F.lit("unknown"))))
