"""Token counts: tokenizers run inside Arrow functions that return lengths only.

Texts go through the tokenizer in batches of about ``BATCH_BYTES``, so a batch of a few long texts costs as much as
one of many short ones. Where the tokenizer drops white space before its merges, every white space is a safe
boundary: a text is cut into words there, equal words of a batch are encoded once, and each worker remembers the
lengths of up to ``CACHE`` words. Any other tokenizer gets whole texts.

Defined results: a null text counts as empty: 0 bytes, 0 tokens. Special strings inside texts are handled as the
library does by default. Equal rows are counted each for itself. An empty table gives an empty table. Columns named
in ``keep`` are carried along whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20
CACHE = 400_000

_loaded: dict[str, tuple] = {}


def drops_space(path: str) -> bool:
    """True if the tokenizer's first split keeps only what matches patterns without white space, so that words are independent."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in config.get("added_tokens", []))
    return plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in pattern


def _tokenizer(path: str) -> tuple:
    """(lengths of a list of texts, word lengths known so far or None); one per worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        _loaded[path] = lengths, {} if drops_space(path) else None
    return _loaded[path]


def _by_bytes(texts: list[bytes]) -> Iterator[list[bytes]]:
    batch, size = [], 0
    for t in texts:
        if batch and size + len(t) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about BATCH_BYTES that end before a space, or whole where no space comes."""
    at = 0
    while len(text) - at > BATCH_BYTES:
        cut = text.rfind(b" ", at + 1, at + BATCH_BYTES)
        if cut < 0 and (cut := text.find(b" ", at + BATCH_BYTES)) < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def lengths(texts: list[bytes], path: str) -> list[int]:
    """Tokens of each UTF-8 text."""
    encode, known = _tokenizer(path)
    out: list[int] = []
    for batch in _by_bytes(texts):
        if known is None:
            out += encode([t.decode() for t in batch])
            continue
        for text in batch:
            total = 0
            for piece in _cut(text):
                words = piece.split()
                if new := set(words).difference(known):
                    if len(known) < CACHE:
                        new = list(new)
                        known.update(zip(new, encode([w.decode() for w in new]), strict=True))
                    else:
                        total += encode([b" ".join([w for w in words if w in new]).decode()])[0]
                total += sum(filter(None, map(known.get, words)))
            out.append(total)
    return out


def count_tokens(docs: DataFrame, path: str, keep: Iterable[str] = ("doc_id",), text: str = "text", limit: int = 2048) -> DataFrame:
    """Columns ``keep``, n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``); ``path`` is a tokenizer file on every executor."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    schema = T.StructType(plain.schema.fields[:-1] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t if t is not None else b"" for t in part.column("text_").cast(pa.binary()).to_pylist()]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(lengths(texts, path), pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    out = plain.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
