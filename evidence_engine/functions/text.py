"""Text preparation as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidence_engine import fixed_values as fv


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone knows only U+0020)."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def normalize(text: Column) -> Column:
    """Unify line ends, squeeze spaces and tabs, keep at most one blank line, strip."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # Most texts have nothing to squeeze, which a search for it shows at a fraction of a replacement's cost.
    squeezed = let(
        lines,
        lambda t: F.when(
            F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, " [ \t]+|\t[ \t]*", " ")
        ).otherwise(t),
    )
    fewer = let(
        squeezed, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t)
    )
    return strip(fewer)


def document_id(source: Column, stripped_text: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit("\0"), stripped_text)), 1, fv.ID_LENGTH)


def chunk_id(document: Column, index: Column, start: Column, end: Column) -> Column:
    key = F.concat_ws(":", document, index.cast("string"), start.cast("string"), end.cast("string"))
    return F.substring(F.sha1(key), 1, fv.ID_LENGTH)


def path_order(source: Column) -> Column:
    """A string whose byte order is the order of paths compared part by part."""
    return F.replace(source, F.lit("/"), F.lit("\0"))


def tokenize(text: Column) -> Column:
    """Lower-case words and single ideographs in text order, then ideograph pairs.

    Pairs join neighbours in the sequence of ideographs, whatever stands between them.
    Only ASCII letters can be matched, so tokens are lowered, not the text: no other letter becomes one.
    """
    words = F.regexp_extract_all(text, F.lit(fv.TOKEN_PATTERN), F.lit(0))
    base = F.transform(words, lambda word: F.lower(word))
    pairs = let(
        F.regexp_extract_all(text, F.lit(fv.IDEOGRAPH_PATTERN), F.lit(0)),
        lambda signs: F.zip_with(
            F.slice(signs, F.lit(1), F.greatest(F.array_size(signs) - 1, F.lit(0))),
            F.slice(signs, F.lit(2), F.greatest(F.array_size(signs) - 1, F.lit(0))),
            lambda left, right: F.concat(left, right),
        ),
    )
    return F.when(F.rlike(text, F.lit(fv.IDEOGRAPH_PATTERN)), F.concat(base, pairs)).otherwise(base)


def term_counts(tokens: Column) -> Column:
    """``ARRAY<STRUCT<term, tf>>`` of one row's tokens, without a shuffle.

    Sort the row's tokens, note where each run begins, and take run lengths.
    """

    def count_runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.array_size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda begin: F.transform(
                begin,
                lambda start, n: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(begin, n + 1), F.array_size(ordered)) - start).cast("bigint").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.array_size(tokens) > 0, let(F.sort_array(tokens), count_runs)).otherwise(empty)
