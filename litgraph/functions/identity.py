"""Identity keys and record scalars, as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_title(title: Column, mode: str = "words") -> Column:
    """Lower case; ``words``: white space collapsed; ``compact``: letters and digits only."""
    low = F.lower(title)
    if mode == "words":
        return F.trim(F.regexp_replace(low, r"\s+", " "))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def arxiv_base(arxiv: Column) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(arxiv, r"v[0-9]+$", "")


def doi_of(value: Column) -> Column:
    """A DOI in lower case, out of a bare DOI, a ``doi:`` form or a URL; null if there is none."""
    plain = F.lower(F.trim(F.regexp_replace(value, "%2[fF]", "/")))
    found = F.regexp_extract(plain, r"(10\.[0-9]{4,9}/[^\s?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"[.,;]+$", ""))


def openalex_of(value: Column) -> Column:
    found = F.regexp_extract(F.upper(F.trim(value)), r"(?:^|/)(W[0-9]+)$", 1)
    return F.when(found != "", found)


def arxiv_of(value: Column) -> Column:
    plain = F.lower(F.trim(value))
    found = F.regexp_extract(plain, r"(?:^|abs/|pdf/|arxiv[:.])([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:\.pdf)?$", 1)
    return F.when(found != "", found)


def work_id(explicit: Column, openalex: Column, doi: Column, arxiv: Column, s2: Column, title: Column, year: Column) -> Column:
    """The first identifier there is, else a digest of title and year."""
    digest = F.substring(F.sha1(F.concat(fold_title(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))), 1, 16)
    return F.coalesce(
        explicit, openalex, F.concat(F.lit("doi:"), F.lower(doi)), F.concat(F.lit("arxiv:"), arxiv_base(arxiv)), F.concat(F.lit("s2:"), s2), F.concat(F.lit("title:"), digest)
    )


def author_id(explicit: Column, orcid: Column, openalex: Column, s2: Column, name: Column) -> Column:
    return F.coalesce(explicit, F.concat(F.lit("orcid:"), orcid), openalex, F.concat(F.lit("s2:"), s2), F.concat(F.lit("name:"), fold_title(name)))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def identity_keys(openalex: Column, doi: Column, arxiv: Column, s2: Column, title: Column, year: Column) -> Column:
    """Keys of a record; a title and year only where there is no identifier."""
    ids = F.array_compact(
        F.array(
            F.concat(F.lit("openalex:"), openalex_of(openalex)), F.concat(F.lit("doi:"), doi_of(doi)),
            F.concat(F.lit("arxiv:"), F.coalesce(arxiv_of(arxiv), arxiv_of(F.regexp_extract(F.lower(doi), r"10\.48550/(arxiv\..+)$", 1)))),
            F.concat(F.lit("s2:"), s2),
        )
    )
    named = F.concat(F.lit("title:"), fold_title(title, "compact"), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.when(F.size(ids) > 0, F.array_distinct(ids)).otherwise(F.array_compact(F.array(named)))


def year_of(value: Column) -> Column:
    """A year from 1000 to 9999 at the start of a text; else null."""
    y = F.regexp_extract(value.cast("string"), r"^\s*([0-9]{4})(?![0-9])", 1)
    return F.when((y != "") & (y.cast("int") >= 1000), y.cast("int"))


def year_allowed(year: Column, from_year: int | None, to_year: int | None) -> Column:
    """An unknown year passes."""
    ok = F.lit(True)
    if from_year is not None:
        ok = ok & (year >= from_year)
    if to_year is not None:
        ok = ok & (year <= to_year)
    return year.isNull() | ok


def escape_query(value: Column) -> Column:
    """Backslashes before the operators of a full-text query."""
    return F.regexp_replace(value, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def titles_match(a: Column, b: Column, least: float = 0.9) -> Column:
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return (fold_title(a, "compact") == fold_title(b, "compact")) | (token_jaccard(split(a), split(b)) >= least)


def match_keys(title: Column, least: float = 0.9) -> Column:
    """Keys of which two titles share one if titles_match: the title without blanks, and so many of its first words in order that two
    sets of that similarity cannot differ in all of them."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda x: x != "")))
    first = F.size(words) - F.ceil(F.size(words) * F.lit(least) - 1e-9).cast("int") + 1
    marked = F.transform(F.slice(words, F.lit(1), F.greatest(first, F.lit(0))), lambda w: F.concat(F.lit("w:"), w))
    return F.concat(F.array(F.concat(F.lit("t:"), fold_title(title, "compact"))), marked)


def gap_id(kind: Column, evidence: Column) -> Column:
    """The digest of a compact JSON array of the type and its sorted evidence."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(evidence), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    return F.sha2(F.concat(F.lit('["'), kind, F.lit('",'), quoted, F.lit("]")), 256)


def iri(kind: str, value: Column, base: str = "https://example.org/id") -> Column:
    return F.concat(F.lit(f"{base}/{kind}/"), F.regexp_replace(F.url_encode(value), r"\+", "%20"))
