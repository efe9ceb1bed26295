"""Templates with ``?`` wildcards: matching, headers and message texts, as built-in expressions."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts users see.
BATCH_HEADER = " similar messages were received:\n"
ONLINE_FOOTER = "\n\nSimilar messages received: "


def template_pieces(template: Column) -> Column:
    """A template as an array of literals and runs of wildcards, in order."""
    return F.regexp_extract_all(template, F.lit(r"(\?+|[^?]+)"), F.lit(1))


def pieces_match(pieces: Column, text: Column) -> Column:
    """Whether a text matches a template given in pieces: a run of n ``?`` takes a run of digits, or up to n
    characters; all else stands for itself.

    Follows the set of places the text can have reached after each piece, so the work grows with the
    template and the text whatever they hold, where a regex may try all combinations of wildcards.
    """
    end = F.char_length(text) + 1

    def after_wildcards(at: Column, n: Column) -> Column:
        def reach(p: Column) -> Column:
            digits = F.char_length(F.regexp_substr(F.substr(text, p), F.lit("^[0-9]*")))
            return F.sequence(p, F.greatest(F.least(p + n, end), p + F.coalesce(digits, F.lit(0))))

        return F.array_distinct(F.flatten(F.transform(at, reach)))

    def after_literal(at: Column, piece: Column) -> Column:
        size = F.char_length(piece)
        return F.transform(F.filter(at, lambda p: F.substr(text, p, size) == piece), lambda p: p + size)

    def step(at: Column, piece: Column) -> Column:
        return F.when(piece.startswith("?"), after_wildcards(at, F.char_length(piece))).otherwise(
            after_literal(at, piece)
        )

    return F.array_contains(F.aggregate(pieces, F.array(F.lit(1)), step), end)


def _digits_only(template: Column) -> Column:
    """A regex for the usual case, in which every run of wildcards takes digits. It takes all of them and gives none
    back, so it never tries combinations."""
    quoted = F.replace(template, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    runs = F.regexp_replace(quoted, r"\?+", r"\\E[0-9]++\\Q")
    return F.concat(F.lit("\\A\\Q"), runs, F.lit("\\E\\z"))


def matches(template: Column, text: Column) -> Column:
    """Whether the text matches the template."""
    return F.when(F.rlike(text, _digits_only(template)), True).otherwise(pieces_match(template_pieces(template), text))


def equivalent(a: Column, b: Column) -> Column:
    """Whether two templates match each other."""
    return matches(a, b) & matches(b, a)


_DIGITS = re.compile("[0-9]*")


@lru_cache(maxsize=10_000)
def _pieces(template: str) -> list[str]:
    return re.findall(r"\?+|[^?]+", template)


def text_matches(template: str, text: str) -> bool:
    """The same rule for one template and text outside of expressions."""
    places = {0}
    for piece in _pieces(template):
        if piece[0] == "?":
            reached: set[int] = set()
            for p in places:
                digits = _DIGITS.match(text, p).end()
                reached.update(range(p, max(min(p + len(piece), len(text)), digits) + 1))
            places = reached
        else:
            places = {p + len(piece) for p in places if text.startswith(piece, p)}
            if not places:
                return False
    return len(text) in places


def parse_header(text: Column) -> tuple[Column, Column]:
    """(count, template) of a grouped message; (0, text) for any other."""
    shape = r"\A([0-9]+)" + BATCH_HEADER + r"([\s\S]*)\z"
    grouped = F.rlike(text, F.lit(shape))
    count = F.when(grouped, F.regexp_extract(text, shape, 1).cast("long")).otherwise(F.lit(0).cast("long"))
    return count, F.when(grouped, F.regexp_extract(text, shape, 2)).otherwise(text)


def format_batch(count: Column, template: Column) -> Column:
    """Text of a group in batch mode."""
    return F.concat(count.cast("string"), F.lit(BATCH_HEADER), template)


def format_online(count: Column, template: Column) -> Column:
    """Text of a group in online mode."""
    return F.concat(template, F.lit(ONLINE_FOOTER), count.cast("string"))
