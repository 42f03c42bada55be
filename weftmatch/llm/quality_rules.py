"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger row keeps the measurements and one integer whose bit i says
that rule i failed. A policy is a versioned set of rules; applying one, or asking what a rule costs, is bit
arithmetic over the ledger and never reads a text again.

Defined results: a null or empty text has no words, so all its measurements are 0 and ``few_words`` fails.
Texts of any length are measured whole. Repeated rows are measured each for itself. An empty table gives an
empty ledger. ``ledger`` carries the columns of ``keep`` along, which may not have the names it adds;
``filter_documents`` carries all columns along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum

SYMBOLS = b"#*$%&|<>"

#: name and type of what is measured
MEASURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_upper": "long",
    "n_alpha": "long",
}


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: the bit of a rule is its place here; rules are only ever appended
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_lines > 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", "100 * n_upper > 40 * n_alpha"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("letters", "100 * n_alpha < 40 * word_chars"),
)

#: policies by version: the rules that reject
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "dup_lines", "upper_case", "word_length", "letters"),
}


#: code points with a place in the tables of letters
_POINTS = 0x32400


def _upper_lower_letters() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are upper-case letters, and that are letters; those beyond 0x32000 are held in no script yet."""
    chars = [chr(i) for i in range(_POINTS)]
    return np.array([c.isupper() for c in chars]), np.array([c.isalpha() for c in chars])


_UPPER, _ALPHA = _upper_lower_letters()
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _case(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Upper-case letters and letters of each text."""
    upper, alpha = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(at + textnum.CHUNK, len(t))
            while end < len(t) and t[end] & 0xC0 == 0x80:  # whole characters
                end += 1
            piece, at = t[at:end], end
            if piece.isascii():
                b = np.frombuffer(piece, np.uint8)
                up = int(np.count_nonzero((b >= 65) & (b <= 90)))
                upper[i] += up
                alpha[i] += up + int(np.count_nonzero((b >= 97) & (b <= 122)))
            else:
                points = np.frombuffer(piece.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                points = points[points < _POINTS]
                upper[i] += int(np.count_nonzero(_UPPER[points]))
                alpha[i] += int(np.count_nonzero(_ALPHA[points]))
    return upper, alpha


def _first_of(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key with doc mixed in), and True where a value differs from the one before in that order."""
    mixed = textnum.mix(key + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    seen = mixed[order]
    return order, np.concatenate(([True], seen[1:] != seen[:-1]))


def _repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    doc = np.repeat(np.arange(len(counts)), counts)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(whole):
        return np.zeros(len(counts), np.int64)
    key = textnum.mix(textnum.mix(words[whole]) * np.uint64(3) + words[whole + 1])
    key = textnum.mix(key * np.uint64(3) + words[whole + 2])
    order, first = _first_of(doc[whole], key)
    again = ~np.concatenate((first[1:], [True])) | ~first
    at = whole[order[again]]
    inside = np.zeros(n, bool)
    inside[at] = inside[at + 1] = inside[at + 2] = True
    return np.bincount(doc[inside], minlength=len(counts))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of some texts."""
    words, n_words = textnum.hash_words_of(texts)
    lines, n_lines = textnum.hash_lines_of(texts)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    distinct = np.zeros(len(texts), np.int64)
    if len(lines):
        order, first = _first_of(doc, lines)
        distinct = np.bincount(doc[order[first]], minlength=len(texts))
    upper, alpha = _case(texts)
    n_symbols, word_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        n_symbols[i] = np.count_nonzero(_IS_SYMBOL[b])
        word_chars[i] = np.count_nonzero(((b & 0xC0) != 0x80) & ~textnum.SPACE[b])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_lines - distinct, "n_repeat_words": _repeat_words(words, n_words), "n_lines": n_lines, "n_upper": upper, "n_alpha": alpha}


def ledger(docs: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``keep``, the measurements and ``failed_bits`` (long): bit i is set where rule i fails."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    schema = T.StructType(plain.schema.fields[:-1] + [T.StructField(k, T.LongType()) for k in MEASURES])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [b if b is not None else b"" for b in part.column("text_").cast(pa.binary()).to_pylist()]
            found = [measure(texts[a:b]) for a, b in textnum.batches(texts)]
            columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in MEASURES]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)), F.lit(0))
    out = plain.mapInArrow(run, schema).withColumn("failed_bits", bits.cast("long"))
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def mask(policy: str | Iterable[str], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy (a version name, or rule names)."""
    names = set(POLICIES[policy]) if isinstance(policy, str) else set(policy)
    if unknown := names - {r.name for r in rules}:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return sum(1 << i for i, r in enumerate(rules) if r.name in names)


def passes(policy: str | Iterable[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablations(led: DataFrame, policy: str | Iterable[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: texts that fail it, that fail it alone, and that pass once it is dropped.

    The ledger is first reduced to its distinct bit patterns, at most 2**len(rules) rows.
    """
    all_bits = mask(policy, rules)
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count("*").alias("n"))
    of_policy = [(i, r.name) for i, r in enumerate(rules) if all_bits >> i & 1]
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in of_policy])).alias("r")
    rows = patterns.select("bits", "n", one)
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were."""
    names = docs.columns
    own = [f"own_{i}" for i in range(len(names))]
    led = ledger(docs.toDF(*own), own, own[names.index(text)])
    return led.where(passes(policy)).select(*[F.col(o).alias(c) for o, c in zip(own, names, strict=True)])
