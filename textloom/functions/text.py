"""Text scalars: hashing, token ids of the stand-in tokenizer, estimates, clipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The stand-in tokenizer's ids: padding, start and end, then words.
PAD, START, END, FIRST_WORD = 0, 1, 2, 3
VOCABULARY = 30_522


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lowercase hex."""
    return F.sha2(text, 256)


def pair_hash(query: Column, document: Column) -> Column:
    """SHA-256 of both texts with a zero byte between, so that no two pairs run together."""
    return F.sha2(F.concat(F.encode(query, "UTF-8"), F.lit(bytearray(b"\0")), F.encode(document, "UTF-8")), 256)


def cache_key(model: Column, input_type: Column) -> Column:
    """Queries and documents of one model are cached apart."""
    return F.when(input_type == "query", F.concat(model, F.lit(":query"))).otherwise(model)


def opaque_id(nanos: Column) -> Column:
    """Id of a request from its time in nanoseconds."""
    return F.concat(F.lit("rrk_"), F.lower(F.hex(nanos.cast("long"))))


def blank(text: Column) -> Column:
    """True for texts of white space only, in Unicode's sense."""
    return text.rlike(r"^\p{IsWhite_Space}*$")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def word_id(word: Column) -> Column:
    """Stable id of a word in the stand-in vocabulary."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % (VOCABULARY - FIRST_WORD) + FIRST_WORD).cast("int")


def token_ids(text: Column) -> Column:
    return F.transform(words(text), word_id)


def clip(ids: Column, longest: int) -> Column:
    return F.slice(ids, 1, longest)


def with_specials(ids: Column, longest: int) -> Column:
    """Start, at most ``longest`` - 2 ids, end."""
    return F.concat(F.array(F.lit(START)), clip(ids, longest - 2), F.array(F.lit(END)))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and one at least."""
    return F.greatest(F.ceil(F.char_length(text) / F.lit(4.0)), F.lit(1)).cast("long")


def padded(ids: Column, width: Column) -> Column:
    """Ids filled up to ``width`` with the padding id."""
    return F.concat(F.slice(ids, F.lit(1), width), F.array_repeat(F.lit(PAD), F.greatest(width - F.size(ids), F.lit(0))))


def mask(ids: Column, width: Column) -> Column:
    """1 for places that hold an id, 0 for padding."""
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: (j < F.size(ids)).cast("int"))).otherwise(F.array().cast("array<int>"))


def leading_ones(mask: Column) -> Column:
    """Ones before the first zero."""
    zero = F.array_position(mask, 0)
    return F.when(zero == 0, F.size(mask)).otherwise(zero - 1).cast("int")


def pair_kept(first: Column, second: Column, most: Column) -> Column:
    """Struct of how many ids of each side of a pair are kept where both have ``most`` places: the longer one is cut first.

    The end that repeated cutting of the longer side comes to: a side of up to half the places is whole, else both
    get half, and the odd place goes to the longer side (to the second of equal ones).
    """
    places = F.greatest(most, F.lit(0))
    short = F.least(first, second)
    less = F.when(short * 2 <= places, short).otherwise(F.floor(places / 2).cast("int"))
    more = places - less
    fits = first + second <= places
    return F.struct(
        F.when(fits, first).when(first > second, more).otherwise(less).cast("int").alias("first"),
        F.when(fits, second).when(first > second, less).otherwise(more).cast("int").alias("second"),
    )


def pair_ids(query: Column, document: Column, longest: int) -> Column:
    """Struct of ``ids`` (start, query, end, document, end; at most ``longest``), ``segments`` (1 from the document on) and both kept lengths."""

    def cut(kept: Column) -> Column:
        a, b = kept["first"], kept["second"]
        ids = F.concat(F.array(F.lit(START)), F.slice(query, F.lit(1), a), F.array(F.lit(END)), F.slice(document, F.lit(1), b), F.array(F.lit(END)))
        segments = F.concat(F.array_repeat(F.lit(0), a + 2), F.array_repeat(F.lit(1), b + 1))
        return F.struct(ids.alias("ids"), segments.alias("segments"), a.alias("query"), b.alias("document"))

    return let(pair_kept(F.size(query), F.size(document), F.lit(longest - 3)), cut)
