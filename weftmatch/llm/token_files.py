"""Token ids as flat binary files.

Layout of a data set in one folder, one set of files for each range of doc_id:

* ``*.bin``  the ids of all its documents one after the other, little-endian unsigned integers of 16 bits, or of 32
  where the vocabulary needs them; every document ends with the end id
* ``*.doc``  signed 64-bit doc_id of each document, in ascending order (a null id is written as -2**63)
* ``*.off``  unsigned 64-bit offsets, one more than documents: where each document starts in the whole data set
* ``manifest/``  Parquet: file, part, n_docs, n_ids, base, width

Documents are dealt out by ranges of doc_id, so a later file holds only larger ids. The first pass encodes and writes
``.bin`` and ``.doc``; a file's base is the prefix sum of n_ids over the files before it (a row a file); the second
pass writes ``.off``. Files carry the name of the attempt that wrote them and only those in the manifest count, so a
task that runs twice does no harm. Reading maps the files into memory.

Encoding: a byte-level merge tokenizer first splits texts into words, a run of letters, digits or marks with the space
before it. Texts of Latin letters whose white space stands apart are split alike here, equal words (by a 64-bit hash)
are encoded once, and each worker remembers up to ``WORDS`` of them. All other texts go to the library whole.

Defined results: a null or empty text is the end id alone. Documents with equal ids stand together, ordered by text.
An empty table gives an empty data set.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textnum import batches, hash_tiles

#: words that a worker remembers, and slots of the table it finds them in
WORDS, SLOTS = 1_500_000, 1 << 22
NO_ID = -(2**63)

#: classes of bytes: space, other white space, letters (all of UTF-8 beyond ASCII), digits, marks
_CLASS = np.full(256, 4, np.int8)
_CLASS[32] = 0
_CLASS[9:14] = 1
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
#: a character beyond ASCII that is no Latin letter
_ODD = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """A tokenizer file with its memory of words; one per worker process."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or "<|" not in t["content"] for t in config.get("added_tokens", []))
        #: words can be encoded one by one
        self.by_word = plain and not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        #: hash -> code by open addressing; the ids of each code
        self.keys, self.codes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_codes = 0

    def _append(self, words: list[bytes]) -> int:
        """Encode some words and keep their ids; the code of the first."""
        found = [x.ids for x in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.array(list(map(len, found)), np.int64)
        ids = np.array(list(chain.from_iterable(found)), np.uint32)
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.start) < self.n_codes + len(sizes):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        at = self.n_codes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[at : at + len(sizes)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at : at + len(sizes)] = sizes
        self.n_ids, self.n_codes = self.n_ids + len(ids), at + len(sizes)
        return at

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Codes of hashes, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(42)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            seen = self.keys[slot]
            hit = seen == h[left]
            out[left[hit]] = self.codes[slot[hit]]
            go = ~hit & (seen != 0)
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _remember(self, h: np.ndarray, first: int) -> None:
        for code, (key, slot) in enumerate(zip(h.tolist(), (h >> np.uint64(42)).tolist(), strict=True), first):
            while self.keys[slot]:
                slot = (slot + 1) & (SLOTS - 1)
            self.keys[slot], self.codes[slot] = key, code

    def _plain(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of some whole texts, as the library gives them for each."""
        out: list[np.ndarray | None] = [np.zeros(0, np.uint32) if not t else None for t in texts]
        fast = [i for i, t in enumerate(texts) if t and self.by_word and b"'" not in t and b"<|" not in t and (t.isascii() or not _ODD.search(t.decode()))]
        if fast:
            sizes = np.array([len(texts[i]) for i in fast])
            begin = np.cumsum(sizes) - sizes
            data = b"".join(texts[i] for i in fast)
            buf = np.frombuffer(data, np.uint8)
            kind = _CLASS[buf]
            fresh = np.ones(len(buf), bool)
            # a run of one class is a word, together with one space before it; white space that is no space stands alone
            fresh[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0) | (kind[1:] == 1)
            fresh[begin] = True
            white = kind <= 1
            meet = white[1:] & white[:-1]
            meet[begin[1:] - 1] = False
            slow = set((np.searchsorted(begin, np.flatnonzero(meet), "right") - 1).tolist())
            starts = np.flatnonzero(fresh)
            h = hash_tiles(buf, starts)
            code = self._find(h)
            back = (self.n_ids, self.n_codes)
            if len(unknown := np.flatnonzero(code < 0)):
                new, place, again = np.unique(h[unknown], return_index=True, return_inverse=True)
                ends = np.append(starts[1:], len(buf))
                where = unknown[place]
                # where white space meets, a word may be cut wrongly; such texts are encoded plainly below
                at = self._append([data[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                code[unknown] = at + again
                if self.n_codes <= WORDS:
                    self._remember(new, at)
                    back = None
            else:
                back = None
            size = self.size[code]
            ends = np.cumsum(size)
            ids = self.ids[np.repeat(self.start[code] - ends + size, size) + np.arange(ends[-1])]
            cuts = np.append(0, ends)[np.searchsorted(starts, np.append(begin, len(buf)))]
            for k, i in enumerate(fast):
                if k not in slow:
                    out[i] = ids[cuts[k] : cuts[k + 1]]
            if back:  # what is not remembered makes room
                self.n_ids, self.n_codes = back
        return [self._plain(t) if x is None else x for t, x in zip(texts, out, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _store(folder: str):
    """File system and path of a folder given as URI or path; opened inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the file system is a local or mounted one."""
    from pyarrow import fs

    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the data set of ``docs`` to a new ``folder`` that executors share; the manifest, a row a file, comes back."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        part, model = TaskContext.get().partitionId(), encoder(path)
        name, n_docs, n_ids = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(f"{at}/{name}.bin") as ids, store.open_output_stream(f"{at}/{name}.doc") as own, store.open_output_stream(f"{at}/{name}.len") as lens:
            for batch in parts:
                sizes = []
                texts = [t if t is not None else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                for a, b in batches(texts):
                    for found in model.encode(texts[a:b]):
                        ids.write(np.append(found, end_id).astype(f"<u{model.width}").tobytes())
                        sizes.append(len(found) + 1)
                own.write(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                lens.write(np.array(sizes, "<u4").tobytes())
                n_docs, n_ids = n_docs + len(sizes), n_ids + sum(sizes)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [n_docs], "n_ids": [n_ids], "width": [model.width]})

    made = f"{folder}/made"
    dealt.mapInArrow(encode, "file string, part long, n_docs long, n_ids long, width long").write.parquet(made)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.parquet(made).withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def offsets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in parts:
            for row in batch.to_pylist():
                sizes = _mapped(store, f"{at}/{row['file']}.len", "<u4")
                with store.open_output_stream(f"{at}/{row['file']}.off") as f:
                    f.write((row["base"] + np.concatenate(([0], np.cumsum(sizes, dtype=np.uint64)))).astype("<u8").tobytes())
            yield batch

    n = max(1, spark.read.parquet(made).count())
    based = based.select("file", "part", "n_docs", "n_ids", "width", "base")
    based.repartitionByRange(n, "part").mapInArrow(offsets, based.schema).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers) of each document, from the files; also ``ids`` if asked for."""
    files = spark.read.parquet(f"{folder}/manifest")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for batch in parts:
            for row in batch.to_pylist():
                ids, own, off = (_mapped(store, f"{at}/{row['file']}.{x}", t) for x, t in (("bin", f"<u{row['width']}"), ("doc", "<i8"), ("off", "<u8")))
                for lo in range(0, len(own), 2000):
                    start = np.asarray(off[lo : lo + 2001], np.int64)
                    spans = [np.asarray(ids[a:b], "<u4") for a, b in zip(start[:-1] - row["base"], start[1:] - row["base"], strict=True)]
                    names = np.asarray(own[lo : lo + 2000], np.int64)
                    columns = {"doc_id": pa.array(names, mask=names == NO_ID), "start": start[:-1], "n_tokens": np.diff(start), "ids_crc32": pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(documents, schema)
