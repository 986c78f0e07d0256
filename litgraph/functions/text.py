"""Text scalars as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short list of English function words.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def stop_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP])


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda x: ~F.array_contains(stop_array(), x))


def clean(value: Column) -> Column:
    """Tags and entities out, white space collapsed, empty to null."""
    out = F.regexp_replace(value, "<[^>]*>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(out != "", out)


def singular(word: Column) -> Column:
    """A light rule for the last word of a keyword."""
    n = F.length(word)
    return (
        F.when(word.rlike("(ss|us|is)$") | (n <= 3), word)
        .when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, 1, n - 3), F.lit("y")))
        .when(word.rlike("(ses|xes|zes|ches|shes)$"), F.substring(word, 1, n - 2))
        .when(word.endswith("s"), F.substring(word, 1, n - 1))
        .otherwise(word)
    )


def once(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def keyword(term: Column) -> Column:
    """Lower case, separators to spaces, edge punctuation off, the last word singular; null without a letter or digit."""
    flat = F.trim(F.regexp_replace(F.lower(term), r"[_/\s-]+", " "))
    flat = F.regexp_replace(flat, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")

    def ended(f: Column) -> Column:
        head = F.length(f) - F.instr(F.reverse(f), " ") + 1  # letters up to the last blank
        cut = F.when(F.instr(f, " ") > 0, head).otherwise(F.lit(0))
        return F.when(f != "", once(cut, lambda n: F.concat(F.substring(f, F.lit(1), n), once(F.substring(f, n + 1, F.length(f)), singular))))

    return once(flat, ended)


def acronym(term: Column) -> Column:
    """Initials of the content words of a term of several; else null."""
    words = content_tokens(term)
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def stem(word: Column) -> Column:
    n = F.length(word)
    out = word
    for end, least in (("s", 5), ("es", 6), ("ed", 6), ("ing", 6), ("edly", 6), ("ingly", 6)):
        cut = len(end)
        fits = word.endswith(end) & (n >= least) & ((n - cut >= 4) if cut > 1 else F.lit(True))
        out = F.when(fits, F.substring(word, F.lit(1), n - cut)).otherwise(out)
    return out


def strip_disambiguator(term: Column) -> Column:
    return F.trim(F.regexp_replace(term, r"\s*\([^()]*\)\s*$", ""))


def disambiguator(term: Column) -> Column:
    found = F.regexp_extract(term, r"\(([^()]*)\)\s*$", 1)
    return F.when(found != "", found)


def strip_links(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://\S+|[\w.+-]+@[\w-]+\.[\w.]+|10\.[0-9]{4,9}/\S+", " ; ")


def phrases(title: Column) -> Column:
    """Content words of two letters or more without digits, and their adjacent pairs."""
    words = F.filter(content_tokens(title), lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]"))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def phrase_contains(outer: Column, inner: Column) -> Column:
    """inner's words stand in outer one after another."""
    return F.contains(F.concat(F.lit(" "), outer, F.lit(" ")), F.concat(F.lit(" "), inner, F.lit(" ")))


def fold(text: Column) -> Column:
    """What passages are compared by: lower case without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def relaxed(text: Column) -> Column:
    """fold() without quotation marks, ellipses and hyphens."""
    return F.regexp_replace(fold(text), "[\"'“”‘’…-]|\\.\\.\\.", "")


def page_text(text: Column) -> Column:
    """Line ends unified, trailing blanks off, hyphenation joined, at most two blank lines."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+(?=\n)", "")
    out = F.regexp_replace(out, r"-\n(?=[a-z])", "")
    return F.rtrim(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def shorten(text: Column, most: int = 1600) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)
