"""Normalisers, tokenizers, sentence splitting, k-grams, hashes and fingerprints as columns.

Texts are worked on by built-in expressions; numbers of whole batches (hashes of words and runs, fingerprints) in Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: abbreviations after which a sentence goes on
ABBREVIATIONS = (
    "tp", "q", "p", "tt", "ts", "ths", "gs", "pgs", "kts", "bs", "mr", "mrs", "ms", "dr", "prof", "vs", "etc", "vd", "vv", "v.v",
    "nxb", "tr", "st", "no", "fig", "hcm", "ltd", "inc", "gmbh", "e.g", "i.e", "a.m", "p.m",
)
#: fixed values: the factor and modulus of the polynomial hash
FACTOR = 31
MODULUS = 1_000_000_007
_CUT = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of the binary product: floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def clamp_percent(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def squeeze(text: Column) -> Column:
    """White space of all kinds to single blanks, trimmed, without decoration (_ * ~ =) at the ends."""
    plain = F.trim(F.regexp_replace(text, r"[\s\p{Z}\u0085​﻿]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"^[_*~=]+\s*", ""), r"\s*[_*~=]+$", ""))


def words(text: Column) -> Column:
    """Tokens of the set and fingerprint algorithms: lower case, punctuation deleted (``_`` kept)."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s_]", ""), r"\s+"), lambda x: x != "")


def tfidf_tokens(text: Column, drop_digits: bool = True) -> Column:
    """Tokens of the vector model; tokens of digits only go where ``drop_digits``."""
    return F.filter(words(text), lambda x: ~_figures(x)) if drop_digits else words(text)


def words_of_clean(clean: Column) -> Column:
    """``words`` of what ``clean_text`` gave and is not empty: it has single blanks and nothing to delete."""
    return F.split(clean, " ")


def tfidf_of_clean(clean: Column) -> Column:
    """``tfidf_tokens`` of what ``clean_text`` gave."""
    return F.filter(words_of_clean(clean), lambda x: (x != "") & ~_figures(x))


def content_of_clean(clean: Column) -> Column:
    """``content_tokens`` of what ``clean_text`` gave."""
    return F.filter(words_of_clean(clean), lambda x: (F.length(x) > 1) & ~_figures(x))


def content_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens that count as words: punctuation and ``_`` split, longer than one character, no stop word, not digits only."""
    stop = stop or []
    bare = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    keep = lambda x: (F.length(x) > 1) & ~_figures(x) & (~x.isin(stop) if stop else F.lit(True))
    return F.filter(bare, keep)


def _figures(x: Column) -> Column:
    """Figures only; the pattern is asked of tokens that begin with one."""
    return (x >= "0") & (x < ":") & x.rlike("^[0-9]+$")


def clean_text(text: Column) -> Column:
    """Lower case, everything but letters and digits to single blanks; the form that is hashed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def syllables(text: Column) -> Column:
    """How many tokens hold a letter."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*"), F.lit(0)))


def eligible(sentence: Column) -> Column:
    """Two tokens or more that hold a letter; what is left by ``clean_text`` is then not empty."""
    return sentence.rlike(r"\p{L}[\p{L}\p{N}]*+[^\p{L}\p{N}][^\p{L}]*+\p{L}")


def _goes_on(piece: Column) -> Column:
    """True if the mark at the end of a piece does not end a sentence. White space of a piece is single blanks."""

    def of(bare: Column) -> Column:
        def told(token: Column) -> Column:
            short = let(F.regexp_replace(token, r"^[^\p{L}\d.]+", ""), lambda x: (F.length(x) <= max(map(len, ABBREVIATIONS))) & F.lower(x).isin(*ABBREVIATIONS))
            number = token.rlike(r"^\d+([.,]\d+)*$") & (F.length(bare) < 15)
            return (token != "") & (short | token.rlike(r"^\p{Lu}$") | number)

        return (bare != piece) & let(F.substring_index(bare, " ", -1), told)

    return let(F.rtrim(piece, F.lit(".!?")), of)


def split_sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph: a cluster of ``.!?``, a blank, then an upper-case letter, digit, quote or opening
    bracket ends one, unless the word before is an abbreviation, a single capital or a leading number."""
    flat = F.trim(F.regexp_replace(paragraph, r"\s+", " "))
    cut = F.split(F.regexp_replace(flat, r"""([.!?]+) (?=[\p{Lu}\d"'(\[«“])""", "$1" + _CUT), _CUT)
    joined = F.array_join(F.transform(cut, lambda x: F.concat(x, F.when(_goes_on(x), F.lit(" ")).otherwise(F.lit(_CUT)))), "")
    return F.filter(F.transform(F.split(joined, _CUT), lambda x: F.trim(x)), lambda x: x != "")


def poly_hash(text: Column) -> Column:
    """Sum of 31^i over the characters, modulo 1 000 000 007."""
    step = lambda acc, c: (acc * FACTOR + F.when(c == "", 0).otherwise(F.ascii(c))) % MODULUS
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def kgrams(tokens: Column, k: int = 3) -> Column:
    """Windows of k words; all words as one where there are fewer; none without words."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(many)

    return let(tokens, of)


def _word_hashes(words_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word the polynomial hash of its code points and 31 to the power of its length, modulo MODULUS."""
    coded = pc.dictionary_encode(words_)
    own = coded.dictionary.to_pylist()
    size = np.fromiter(map(len, own), np.int64, len(own))
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(size) - size
    h, m = np.zeros(len(own), np.int64), np.ones(len(own), np.int64)
    # all words that long at once, a code point at a time
    left = np.arange(len(own))
    for i in range(int(size.max(initial=0))):
        left = left[size[left] > i]
        h[left] = (h[left] * FACTOR + points[begin[left] + i]) % MODULUS
        m[left] = m[left] * FACTOR % MODULUS
    which = coded.indices.to_numpy(zero_copy_only=False)
    return h[which], m[which]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a list column, where each list begins in them and how many it has; a null has none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.cumsum(size) - size, size


def _as_lists(values: np.ndarray, size: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of ``size`` values each; null where ``like`` is."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    nulls = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()), mask=nulls)


def _within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes, laid end to end, the list of each value and its place there."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - (np.cumsum(size) - size)[row]


def hashed_runs(column: pa.Array, k: int) -> pa.Array:
    """``kgram_hashes`` of a batch."""
    flat, begin, size = _lists(column)
    h, m = _word_hashes(flat)
    many = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row, i = _within(many)
    at, long = begin[row] + i, np.minimum(size[row], k)
    out = h[at] if len(at) else h[:0]
    for j in range(1, k):
        on = np.flatnonzero(long > j)
        b = at[on] + j
        out[on] = ((out[on] * FACTOR + 32) % MODULUS * m[b] + h[b]) % MODULUS
    return _as_lists(out, many, column)


def winnowed(column: pa.Array, window: int) -> pa.Array:
    """``fingerprints`` of a batch."""
    flat, begin, size = _lists(column)
    h = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    many = np.where(size >= window, size - window + 1, np.minimum(size, 1))
    row, i = _within(many)
    first, wide = begin[row] + i, np.minimum(size[row], window)
    place, least = first.copy(), h[first] if len(first) else h[:0]
    for j in range(1, window):
        on = np.flatnonzero(wide > j)
        b = first[on] + j
        lower = h[b] <= least[on]  # the rightmost of equal ones
        place[on[lower]], least[on[lower]] = b[lower], h[b[lower]]
    # places never go back within a list, so repeats stand side by side
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    return _as_lists(least[fresh], np.bincount(row[fresh], minlength=len(size)) if len(row) else many, column)


def kgram_hashes(tokens: Column, k: int = 3) -> Column:
    """``poly_hash`` of each k-gram. Each word is hashed once; hash(a + ' ' + b) = (hash(a) * 31 + 32) * 31^|b| + hash(b)."""

    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        return hashed_runs(column, k)

    return of(tokens)


def fingerprints(hashes: Column, window: int = 4) -> Column:
    """Winnowing: the rightmost minimum of every window, once per position; the minimum alone where the list is shorter."""

    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        return winnowed(column, window)

    return of(hashes)


def summed_units(column: pa.Array) -> pa.Array:
    """``string_hash`` of a batch: every code point times its power of 31, summed up."""
    own = column.to_pylist()
    size = np.fromiter((len(t or "") for t in own), np.int64, len(own))
    points = np.frombuffer("".join(t or "" for t in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row, i = _within(size)
    powers = np.cumprod(np.concatenate([[1], np.full(int(size.max(initial=0)), 31)]).astype(np.uint32), dtype=np.uint32).astype(np.uint64)
    # sums run over 2^64, of which 2^32 is a divisor
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[size[row] - 1 - i], dtype=np.uint64)])
    ends = np.cumsum(size)
    signed = (sums[ends] - sums[ends - size]).astype(np.uint32).view(np.int32)
    return pa.array(np.abs(signed.astype(np.int64)), pa.int64(), mask=np.array([t is None for t in own], bool))


def string_hash(text: Column) -> Column:
    """31 times the sum so far plus the code point, in 32 bits, without its sign."""
    return F.arrow_udf(summed_units, "bigint")(text)


def parse_page_range(spec: Column, pages: Column) -> Column:
    """``5`` alone: 5 to the end; lists, ``a-b`` in either order; invalid parts ignored; clamped, distinct, sorted."""
    parts = F.transform(F.split(F.regexp_replace(spec, "–", "-"), "[,;]"), lambda x: F.trim(x))
    alone = F.size(parts) == 1

    def span(p: Column) -> Column:
        a, b = (F.regexp_extract(p, r"^(\d{1,6})\s*-\s*(\d{1,6})$", i) for i in (1, 2))
        one = F.regexp_extract(p, r"^(\d{1,6})$", 1)
        lo = F.when(a != "", F.least(a.cast("int"), b.cast("int"))).when(one != "", one.cast("int"))
        hi = F.when(a != "", F.greatest(a.cast("int"), b.cast("int"))).when(one != "", F.when(alone, pages).otherwise(one.cast("int")))
        first, last = F.greatest(lo, F.lit(1)), F.least(hi, pages)  # these pass over nulls
        return F.when(lo.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def floor_percentile(values: Column, p: float) -> Column:
    """The value at floor(p * (n - 1)) of the sorted array; no interpolation."""
    return F.element_at(F.array_sort(values), F.floor(F.lit(p) * (F.size(values) - 1)).cast("int") + 1)


def mark_keyword(text: Column, keyword: str) -> Column:
    """Every occurrence of a keyword, whatever its case, within <mark> tags."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in keyword)
    return F.regexp_replace(text, f"(?iu){quoted}", "<mark>$0</mark>") if keyword else text
