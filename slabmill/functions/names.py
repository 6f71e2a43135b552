"""Name normalisation and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their base letters
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def normalize_name(name: Column) -> Column:
    """Lower case, no accents, trimmed."""
    return F.trim(F.translate(F.lower(name), ACCENTED, PLAIN))


def name_key(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def sorted_words(name: Column) -> Column:
    return F.array_join(F.sort_array(F.split(normalize_name(name), r"\s+")), " ")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))


def name_similarity(a: Column, b: Column) -> Column:
    """Better of the plain and the word-order-free edit ratio."""
    x, y = normalize_name(a), normalize_name(b)
    return F.greatest(edit_ratio(x, y), edit_ratio(sorted_words(a), sorted_words(b)))


PIECE = 4


def _cut(name: Column, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(F.substring(name, i + 1, F.lit(PIECE)).alias("piece"), i.alias("at")))


def pieces(name: Column) -> Column:
    """(piece, at): the name's letters in neighbouring pieces of four, the rest left out; a shorter name is one piece.

    A name of ``n`` letters has at least ``n // 4`` of them, more than the edits that a similarity of 0.88 leaves room for
    (at most 0.12 / 0.88 of ``n``). Of two such names, one piece of the first is therefore whole in the second.
    """
    return _cut(name, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(name) / PIECE) - 1, F.lit(0))), lambda i: i * PIECE))


def stretches(name: Column) -> Column:
    """(piece, at): every stretch of four letters of the name; their number grows with its length."""
    return _cut(name, F.sequence(F.lit(0).cast("bigint"), F.greatest(F.length(name) - PIECE, F.lit(0)).cast("bigint")))
