"""SentencePiece encoding and decoding with the N best segmentations.

A text becomes ``▁`` + text with spaces written as ``▁``, and its lattice has an edge for every piece of the model
that matches there; a character without a piece is one edge of byte pieces. The forward Viterbi pass gives each
position the best score of any path to it. The backward A* search starts at the end and extends paths towards the
front; the forward score is the exact value of what is still missing, so complete paths come out best first and
nothing is expanded in vain.

A model of merges stores the rank of a piece and no probability; the score of the piece of rank r is the logarithm of
a Zipf law, ``-log((r + 1) * H)`` with H the harmonic sum over the vocabulary, byte pieces ranking last.

No piece spans a word start, a line break or most places between letters and punctuation, so the lattice falls apart
at such cuts. Equal parts are solved once per worker (``CACHE``), with their best and second best score. Of a whole
text, only the N - 1 parts with the smallest difference between the two can differ among its N best segmentations;
A* runs over the joined lattice of these, the other parts standing at their best. The first segmentation is the one of
``ids``. Ties: where scores are equal, Viterbi keeps the piece that begins first in the text, the agenda takes what was
pushed first, and of parts with equal differences numpy's partition order decides; all of it is a function of the text and
the model alone, so equal texts get equal results on every executor.

Defined results: a null or empty text has no pieces, score 0 and the one empty segmentation. Decoding gives back the
text, a ``▁`` of its own included. Texts of any length are encoded whole. Equal rows are encoded each for itself; an empty
table gives an empty table; columns named in ``keep`` are carried along whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum

#: parts that a worker keeps solved, and parts that it keeps the lattice of
CACHE, LATTICES = 400_000, 20_000
_NONE = -math.inf
#: where no piece begins
_NOWHERE: tuple[float | None, dict] = (None, {})
#: stands for a ``▁`` of the text itself, which is written in bytes; no text holds half a surrogate pair
_MARK = "\udcff"

_models: dict[str, "Model"] = {}


class Model:
    """The pieces of a model file, with the parts solved so far; one per worker process."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        harmonic = sum(1 / (r + 1) for r in range(size))
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.score = {model.id_to_piece(i): -math.log((r + 1) * harmonic) for i, r in rank.items()}
        self.id = {model.id_to_piece(i): i for i in plain}
        self.byte_score = -math.log(size * harmonic)
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        #: a score for pieces, None for what only begins one
        self.begins: dict[str, float | None] = {p[:k]: None for p in self.score for k in range(1, len(p))}
        self.begins.update(self.score)
        #: the same as a tree: character -> (score or None, what goes on from there)
        self.tree: dict[str, tuple[float | None, dict]] = {}
        inner = {"": self.tree}
        for begin in sorted(self.begins, key=len):
            inner[begin] = {}
            inner[begin[:-1]][begin[-1]] = (self.begins[begin], inner[begin])
        self._cuts()
        self.bytes_of = [b""] * size
        for piece, i in self.id.items():
            self.bytes_of[i] = piece.replace("▁", " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        sizes = np.array([len(b) for b in self.bytes_of])
        self.flat, self.flat_start, self.flat_size = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(sizes) - sizes, sizes
        #: part -> its place in ``best`` (scores), ``second`` (second best scores), ``start`` and ``size`` (of its ids in ``ids``)
        self.known: dict[str, int] = {}
        self.best, self.second, self.start, self.size, self.ids = array("d"), array("d"), array("q"), array("q"), array("i")
        self.lattices: dict[str, tuple[list[list[tuple[int, float]]], list[float]]] = {}

    def _cuts(self) -> None:
        """Where texts fall apart: at word starts, at line breaks, and between a letter or digit and an ASCII mark that
        no piece has behind one."""
        first = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        for p in self.score:
            for a, b in zip(p, p[1:], strict=False):
                if b == "▁" and a != "▁" or "\n" in (a, b):
                    raise ValueError(f"the piece {p!r} reaches over a word start or a line break")
                if a.isalnum():
                    first.discard(b)
        s = re.escape("".join(sorted(first)))
        more = rf"(?:(?<![^\W_])[{s}]+[^▁\n{s}]*)*"
        self.parts = re.compile(rf"\n|▁*[^▁\n{s}]+{more}|▁*[{s}]+[^▁\n{s}]*{more}|▁+" if first else r"\n|▁*[^▁\n]+|▁+").findall

    def edges(self, part: str) -> Iterator[tuple[int, int, float]]:
        """(from, to, score) of every edge, in order of from."""
        begins, n = self.begins, len(part)
        for i in range(n):
            if begins.get(part[i], _NONE) in (None, _NONE):
                yield i, i + 1, self.byte_score * len(part[i].replace(_MARK, "▁").encode())
            for j in range(i + 1, n + 1):
                s = begins.get(part[i:j], _NONE)
                if s is None:
                    continue
                if s == _NONE:
                    break
                yield i, j, s

    def ids_of(self, piece: str) -> tuple[int, ...]:
        i = self.id.get(piece)
        return (i,) if i is not None else tuple(self.byte_id[b] for b in piece.replace(_MARK, "▁").encode())

    def solve(self, part: str) -> int:
        """Forward Viterbi: the place of the part's best segmentation and second best score, behind all others."""
        n, first, ids_of = len(part), self.tree.get, self.id.get
        best, second, back = [_NONE] * (n + 1), [_NONE] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            one, two = best[i], second[i]
            s, on = first(part[i], _NOWHERE)
            if s is None:
                s = self.byte_score * len(part[i].replace(_MARK, "▁").encode())
            j = i + 1
            while True:
                if s is not None:
                    a = one + s
                    if a > best[j]:
                        b = two + s
                        second[j] = best[j] if best[j] > b else b
                        best[j], back[j] = a, i
                    elif a > second[j]:
                        second[j] = a
                if j == n or not on or (step := on.get(part[j])) is None:
                    break
                s, on = step
                j += 1
        ids, at = [], n
        while at:
            piece = part[back[at] : at]
            i = ids_of(piece)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(reversed(self.ids_of(piece)))
            at = back[at]
        ids.reverse()
        self.start.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)
        self.best.append(best[n])
        self.second.append(second[n])
        return len(self.best) - 1

    def lattice(self, part: str) -> tuple[list[list[tuple[int, float]]], list[float]]:
        """The edges into each position, and the best score up to it."""
        if part in self.lattices:
            return self.lattices[part]
        arcs: list[list[tuple[int, float]]] = [[] for _ in range(len(part) + 1)]
        best = [0.0] + [_NONE] * len(part)
        for i, j, s in self.edges(part):
            arcs[j].append((i, s))
            if best[i] + s > best[j]:
                best[j] = best[i] + s
        if len(self.lattices) < LATTICES:
            self.lattices[part] = arcs, best
        return arcs, best

    def n_best(self, parts: list[str], n: int) -> list[tuple[float, list[tuple[int, ...]]]]:
        """The n best (score, ids of each part) of the joined lattice of some parts: A* from the end."""
        found = [self.lattice(part) for part in parts]
        into, front = [arcs for arcs, _ in found], [best for _, best in found]
        before = [0.0]  # best scores of all parts in front of a part
        for best in front:
            before.append(before[-1] + best[-1])
        count = 0
        agenda = [(-before[-1], count, len(parts) - 1, len(parts[-1]) if parts else 0, 0.0, None)]
        out = []
        while agenda and len(out) < n:
            cost, _, k, at, behind, path = heapq.heappop(agenda)
            while k >= 0 and at == 0:
                k -= 1
                at = len(parts[k]) if k >= 0 else 0
            if k < 0:
                ids: list[list[int]] = [[] for _ in parts]
                while path is not None:
                    (p, i, j), path = path
                    ids[p].extend(self.ids_of(parts[p][i:j]))
                out.append((-cost, [tuple(x) for x in ids]))
                continue
            for i, s in into[k][at]:
                count += 1
                heapq.heappush(agenda, (-(behind + s + front[k][i] + before[k]), count, k, i, behind + s, ((k, i, at), path)))
        return out

    def encode(self, text: str, n: int) -> tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]], np.ndarray]:
        """Ids of the best segmentation; the n best scores; for each of these, ids of the parts that differ from the best;
        where each part's ids end in the best (0 first)."""
        if not text:
            return np.zeros(0, np.int32), [0.0], [{}], np.zeros(1, np.int64)
        if "▁" in text:
            text = text.replace("▁", _MARK)
        parts = self.parts("▁" + text.replace(" ", "▁"))
        places, full = list(map(self.known.get, parts)), None
        if None in places:
            solved = self.known
            if len(solved) >= CACHE:
                full, solved = (len(self.best), len(self.ids)), {}
            k = -1
            for _ in range(places.count(None)):
                k = places.index(None, k + 1)
                p = parts[k]
                if p not in solved:
                    solved[p] = self.solve(p)
                places[k] = solved[p]
        at = np.array(places)
        best, second, start, size = (np.frombuffer(x, t)[at] for x, t in ((self.best, "f8"), (self.second, "f8"), (self.start, "i8"), (self.size, "i8")))
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(self.ids, np.int32)[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        if full is not None:
            # what only this text has, once the table is full
            for x, k in ((self.best, full[0]), (self.second, full[0]), (self.start, full[0]), (self.size, full[0]), (self.ids, full[1])):
                del x[k:]
        total = math.fsum(best.tolist())
        if n == 1:
            return flat, [total], [{}], ends
        loss = best - second
        at = np.sort(np.argpartition(loss, n - 2)[: n - 1]) if len(loss) >= n else np.arange(len(loss))
        at = at[np.isfinite(loss[at])].tolist()
        ways = self.n_best([parts[i] for i in at], n)
        rest = total - math.fsum(best[at].tolist())
        # of equal scores the best ids come first; where even n others are equal to them, for the last of these
        first, others = [tuple(flat[ends[i] : ends[i + 1]].tolist()) for i in at], [w for _, w in ways]
        others = [first, *[w for w in others if w != first]][: len(ways)]
        return flat, [rest + s for s, _ in ways], [{k: x for k, x, y in zip(at, w, first, strict=True) if x != y} for w in others], ends

    def segmentations(self, flat: np.ndarray, ways: list[dict[int, tuple[int, ...]]], ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the n best, from what ``encode`` returns."""
        out = []
        for way in ways:
            pieces, at = [], 0
            for k, ids in way.items():
                pieces += [flat[at : ends[k]], np.array(ids, np.int32)]
                at = ends[k + 1]
            out.append(np.concatenate([*pieces, flat[at:]]) if way else flat)
        return out

    def bytes_from(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids."""
        if not len(ids):
            return ""
        size = self.flat_size[ids]
        ends = np.cumsum(size)
        raw = self.flat[np.repeat(self.flat_start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        return raw.decode("utf-8", "replace")[1:]


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of some arrays of ids."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, n_best: int = 4, keep: Iterable[str] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """Columns ``keep``; n_pieces, ids_crc32 (of the best ids as little-endian 32-bit integers), scores (of the n best,
    best first), decoded (each of the n best gives back the text); with ``with_ids`` also ids and n_best_ids."""
    keep = list(keep)
    plain = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text_"))
    added = "n_pieces long, ids_crc32 long, scores array<double>, decoded boolean" + ", ids array<int>, n_best_ids array<array<int>>" * with_ids
    schema = T.StructType(plain.schema.fields[:-1] + T.StructType.fromDDL(added).fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in parts:
            texts = [t if t is not None else b"" for t in part.column("text_").cast(pa.binary()).to_pylist()]
            for a, b in textnum.batches(texts):
                n_pieces, crcs, all_scores, decoded, firsts, ways_of, n_ways = [], [], [], [], [], [], [0]
                for raw in texts[a:b]:
                    t = raw.decode()
                    ids, scores, ways, ends = own.encode(t, n_best)
                    each = own.segmentations(ids, ways, ends) if with_ids else []
                    n_pieces.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    all_scores.append(scores)
                    # the best is decoded whole; of the others, what differs from it
                    decoded.append(own.decode(ids) == t and all(own.bytes_from(ids[ends[k] : ends[k + 1]].tolist()) == own.bytes_from(way[k]) for way in ways for k in way))
                    if with_ids:
                        firsts.append(ids)
                        ways_of.extend(each)
                        n_ways.append(len(ways_of))
                made = [pa.array(n_pieces, pa.int64()), pa.array(crcs, pa.int64()), pa.array(all_scores, pa.list_(pa.float64())), pa.array(decoded, pa.bool_())]
                if with_ids:
                    made += [_lists(firsts), pa.ListArray.from_arrays(pa.array(n_ways, pa.int32()), _lists(ways_of))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in part.columns[:-1]), *made], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of the array column ``ids`` in the new column ``to``; null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in parts:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
