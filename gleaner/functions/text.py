"""Column functions over text: tokens, lines, previews, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line when text is split into lines.
BREAK = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
#: The same as characters, the usual one first.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Limits on what is shown to a scorer (fixed values).
PREVIEW_CHARS, PREVIEW_HEAD, EXCERPT_CHARS, DESCRIPTOR_CHARS = 2400, 400, 4000, 3200


def once(value: Column, then) -> Column:
    """then(value), with the value worked out once for a row: a plain expression is worked out anew wherever
    it stands, inside a lambda for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the lower-case text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines with their ends kept; a final break makes no further line. A pattern is slow on long texts, so
    those with the usual break alone are split at it."""

    def at_break(parts: Column) -> Column:
        n = F.size(parts)
        kept = F.slice(parts, F.lit(1), n - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))
        return F.transform(kept, lambda line, i: F.when(i < n - 1, F.concat(line, F.lit("\n"))).otherwise(line))

    def split(whole: Column) -> Column:
        other = F.lit(False)
        for c in BREAKS[1:]:
            other = other | F.contains(whole, F.lit(c))
        matched = F.regexp_extract_all(whole, F.lit(f"[^{BREAK}]*+(?:\\r\\n|[{BREAK}])|[^{BREAK}]++"), F.lit(0))
        return F.when(other, matched).otherwise(once(F.split(whole, "\n"), at_break))

    return once(F.coalesce(text, F.lit("")), split)


def bare(line: Column) -> Column:
    """A line without its end."""
    return F.rtrim(line, F.lit(BREAKS))


def numbered(kept_lines: Column, first: int = 1) -> Column:
    """Lines with five-digit numbers in front, joined."""
    return F.array_join(F.transform(kept_lines, lambda line, i: F.concat(F.lpad((i + first).cast("string"), 5, "0"), F.lit(": "), line)), "")


#: Words of a question that say nothing about what is asked for (fixed values).
ASKING = ("the", "and", "for", "what", "where", "how", "does")


def preview(text: Column, query: Column, start_line: Column | int = 1) -> Column:
    """A short text whole; of a long one its head and, with their numbers, the lines that hold a query term
    of three characters or more."""
    words = F.transform(F.regexp_extract_all(query, F.lit(r"(?U)[\w-]{3,}"), F.lit(0)), F.lower)
    terms = F.filter(F.array_distinct(words), lambda t: ~t.isin(*ASKING))

    def matches(found: Column) -> Column:
        named = F.transform(lines(text), lambda line, i: F.struct(F.concat(F.lit("L"), (i + start_line).cast("string"), F.lit(": "), bare(line)).alias("shown"), F.lower(line).alias("line")))
        return F.transform(F.filter(named, lambda x: F.exists(found, lambda t: F.contains(x["line"], t))), lambda x: x["shown"])

    def cut(shown: Column) -> Column:
        marked = F.concat(F.substring(text, 1, PREVIEW_HEAD), F.lit("\n...\n"), F.array_join(shown, "\n"))
        return F.substring(F.when(F.size(shown) == 0, text).otherwise(marked), 1, PREVIEW_CHARS)

    return F.when(F.char_length(text) <= PREVIEW_CHARS, text).otherwise(once(once(terms, matches), cut))


def stem(name: Column) -> Column:
    """A name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_of(name: Column) -> Column:
    """A directory's title: dashes and underscores to blanks, a capital after anything that is not a letter."""
    spaced = F.translate(name, "-_", "  ")
    words = F.regexp_extract_all(F.lower(spaced), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def lenient_bool(value: Column) -> Column:
    """True for 1, true, yes and y in any case; false for anything else, null too."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def clamp(start: Column, end: Column, n_lines: Column) -> tuple[Column, Column]:
    """A span inside a file of n lines: both ends are clamped and the end is not before the start."""
    low = F.greatest(F.lit(1), F.least(start, F.greatest(n_lines, F.lit(1))))
    return low, F.greatest(low, F.least(end, F.greatest(n_lines, F.lit(1))))


def judge_score(score: Column) -> Column:
    """A judge's mark of 1 to 5 as 0 to 1; any other is an error."""
    return F.when(score.between(1, 5), (score.cast("double") - 1) / 4).otherwise(F.raise_error(F.concat(F.lit("mark out of range: "), score.cast("string"))).cast("double"))
