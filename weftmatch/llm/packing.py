"""Packing of documents into sequences of equal capacity by Karmarkar-Karp multiway differencing.

Texts are encoded and every ``capacity`` ids in a row form a full sequence of their own. What is left of each document
is dealt into groups of about ``GROUP_BYTES`` of text, at random over rows, so that neither copies nor one source nor one
long document make a group large. Each group is then divided into windows: a partial partition is a list of window
sums, at first one remainder and empty windows; the two partial partitions of the largest difference are merged, the
largest sums of one meeting the smallest of the other, until one is left. That gives windows of nearly equal sums. If
the largest exceeds the capacity, the number of windows rises and the differencing starts again.

So that the last differences are small, the longest remainders of a group, ``FINE_SHARE`` of its ids, are cut into pieces of
about ``FINE`` ids. Where the window count would rise by more than a hundredth (many documents of one length just over half
the capacity, say), all remainders are cut, into halves, quarters and so on.

Defined results: a null or empty text is the end id alone. Repeated rows and null ids are packed each for itself; a
piece is told by its row, not by its id. Each id lies in exactly one piece, and the pieces of a sequence stand without
gaps. An empty table gives an empty table. Columns named in ``keep`` are carried along whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import batches
from .token_files import encoder

#: text and rows of a group; the share of a group's ids that is cut finely, and how finely
GROUP_BYTES, GROUP_ROWS = 1 << 20, 8192
FINE_SHARE, FINE = 0.02, 8
#: sequence ids are group * WINDOWS + number within the group
WINDOWS = 1 << 24
OUT_BYTES = 8 << 20


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums of nearly equal windows in falling order, empty ones left out, and the pieces (by number) of each."""
    heap = [(-size, i, np.array([size]), [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for order in range(len(sizes), 2 * len(sizes) - 1):
        (_, _, a, of_a), (_, _, b, of_b) = heapq.heappop(heap), heapq.heappop(heap)
        # windows beyond the lists are empty; as many as do not fit side by side meet, small ones large ones
        meet = max(0, len(a) + len(b) - windows)
        at, bt = len(a) - meet, len(b) - meet
        sums = np.concatenate((a[:at], a[at:] + b[bt:][::-1], b[:bt]))
        of = of_a[:at] + [x + y for x, y in zip(of_a[at:], of_b[bt:][::-1], strict=True)] + of_b[:bt]
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (int(least - sums[0]), order, sums, [of[i] for i in by.tolist()]))
    return (heap[0][2], heap[0][3]) if heap else (np.zeros(0, np.int64), [])


def even_cuts(size: int, most: int) -> list[int]:
    """A length in as few nearly equal parts of at most ``most`` as can be."""
    n = -(-size // most)
    return [size // n + (i < size % n) for i in range(n)]


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (remainder by number, start within it, length), each of at most ``capacity``."""
    least = -(-sum(sizes) // capacity)
    longest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    grain = capacity
    while True:
        pieces, fine = [], FINE_SHARE * sum(sizes)
        for i in longest:
            start = 0
            for size in even_cuts(sizes[i], FINE if fine > 0 else grain):
                pieces.append((i, start, size))
                start += size
            fine -= sizes[i]
        windows = least
        while True:
            sums, of = differencing([size for _, _, size in pieces], windows)
            if not len(sums) or sums[0] <= capacity:
                return [[pieces[i] for i in own] for own in of]
            windows += 1
            if grain > FINE and windows > least + max(1, least // 100):
                break
        grain //= 2


def sequences(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row a piece: ``keep``, start (ids of its document before it), length, doc_tokens, sequence_id, offset (within the sequence), ids.

    ``ids`` are little-endian unsigned 32-bit integers; the pieces of a sequence in order of offset are its content."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    n_bytes, n_rows = plain.agg(F.coalesce(F.sum(F.octet_length("text_")), F.lit(0)), F.count("*")).first()
    n_groups = max(1, -(-n_bytes // GROUP_BYTES), -(-n_rows // GROUP_ROWS))
    own = plain.schema.fields[:-1]
    long, n_own = T.LongType(), len(own)
    encoded = T.StructType(own + [T.StructField("start", long), T.StructField("doc_tokens", long), T.StructField("ids", T.BinaryType())])
    packed = T.StructType(own + [T.StructField(c, long) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for part in parts:
            texts = [t if t is not None else b"" for t in part.column("text_").cast(pa.binary()).to_pylist()]
            row, start, whole, ids, size = [], [], [], [], 0
            for a, b in batches(texts):
                for i, found in enumerate(model.encode(texts[a:b]), a):
                    found = np.append(found, end_id).astype("<u4")
                    for at in range(0, len(found), capacity):
                        row.append(i)
                        start.append(at)
                        whole.append(len(found))
                        ids.append(found[at : at + capacity].tobytes())
                    size += 4 * len(found)
                if size > OUT_BYTES or b == len(texts):
                    columns = [c.take(pa.array(row, pa.int64())) for c in part.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(start, pa.int64()), pa.array(whole, pa.int64()), pa.array(ids, pa.binary())], names=encoded.names)
                    row, start, whole, ids, size = [], [], [], [], 0

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        group, starts, ids = key[0].as_py(), table["start"].to_pylist(), table["ids"].to_pylist()
        full = [i for i, x in enumerate(ids) if len(x) == 4 * capacity]
        rest = [i for i, x in enumerate(ids) if len(x) < 4 * capacity]
        windows = [[(i, 0, capacity)] for i in full] + [[(rest[i], at, size) for i, at, size in w] for w in pack([len(ids[i]) // 4 for i in rest], capacity)]
        row, number, offset, at, size = [], [], [], [], []
        for k, window in enumerate(windows):
            filled = 0
            for i, begin, length in window:
                row.append(i)
                number.append(group * WINDOWS + k)
                offset.append(filled)
                at.append(begin)
                size.append(length)
                filled += length
        columns = [c.take(pa.array(row, pa.int64())) for c in table.columns]
        start = [starts[i] + a for i, a in zip(row, at, strict=True)]
        cut = [ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(row, at, size, strict=True)]
        out = [*columns[:n_own], pa.array(start, pa.int64()), pa.array(size, pa.int64()), columns[n_own + 1], pa.array(number, pa.int64()), pa.array(offset, pa.int64()), pa.array(cut, pa.binary())]
        return pa.Table.from_arrays(out, names=packed.names)

    # the number of a piece is the same each time its partition is read, so a task that runs again deals alike
    dealt = plain.mapInArrow(encode, encoded).withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return dealt.groupBy("group_").applyInArrow(lambda key, table: fill(key, table.drop_columns(["group_"])), packed).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})
