"""N-gram Jaccard join with token-combination prefixes, and the groups its links make.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with the same set form a class;
links are sought between classes only, so copies are never expanded into pairs.

Let a set of n tokens need ``a = ceil(t * n)`` common ones to link at all. In one global order of tokens (their hash),
two linked sets share at least k tokens among their first ``n - a + k``. With ``k = n - a + 1``:

1. *extended prefixes* are indexed by token; tokens that no second class has are dropped, and a class survives only if
   it keeps as many as its smallest possible partner must share with it. This is done twice.
2. *stars*: survivors are compared with the smallest class under each of their first tokens. That joins most groups
   of near copies with one comparison a member.
3. *combinations*: the rest is exact. The whole sets of the survivors are ordered anew, tokens of few classes first, so
   that tokens of one class alone, which are keys to nothing, fill the prefixes of all but real near copies. Tokens of
   at most ``RARE`` classes are keys of their own. The classes under a more frequent token would all meet, so it is
   combined: they are compared with the smallest class that has it, the centre, and those that do not link with it are keyed by
   pairs of the centre and a token of the difference to it. If x and y link and y does not link with the centre c, their
   differences D to c share more than (|D(x)| + k (|c| - |x|)) / 2 tokens, with k = (1 - t) / (1 + t); so the first
   |D(x)| - that tokens of D(x) hold a shared one, again with tokens of one class alone first. Keys whose classes already
   belong to one group are dropped. Under the others each class is first compared with one of another group, the smallest and then the
   largest, which joins large groups of near copies with one comparison a class and key; only classes of groups that are different
   still, and of about equal size, make candidates.

Candidates pass a parity filter before anything else is read for them: bit b of a set's 1024 is the parity of its
tokens that hash to b, and two sets differ in at least as many tokens as bits. The rest is verified on the whole sets,
one partner a class at first: what that links need not be verified again.

Defined results: null text, empty text and text without words have n_shingles 0 and stand alone. A text with fewer
words than a shingle has the whole sequence as its one shingle. doc_id is an integer (or text that holds one; other
text is an error). Rows without doc_id link as others do and get the component_id of their group, null where no row of it
has a doc_id. Repeated rows and ties are members of one class. Texts of any length are read whole. Other columns, whatever
their names, do not matter here; ``one_of_each`` carries them along. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .shared import Scratch, components, each_once, row_keys

#: tokens of more classes than this are indexed in pairs with a token of the difference to a centre
RARE = 200
#: tokens by which a survivor looks for a star to join
STARS = 3
#: rounds that verify one pair a group, before the rest is verified
TURNS = 2
#: rounds that compare the classes under a key with one of them, before all of different groups are compared
KEY_STARS = 2
#: numbers of 64 parity bits of a set
PARITY = 16
#: parities are broadcast up to this many classes (35 MB), and shuffled beyond
BROADCAST_ROWS = 1 << 18
#: stands for a doc_id that is null
NO_ID = -(2**63)
#: most bits of the filter that spares the second reading of texts that did not survive (32 MB)
FILTER_BITS = 1 << 28


def _set_of(text: bytes | None, words: int) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    return np.unique(textnum.shingles(textnum.hash_words(text, lower=True), words).view(np.int64))


def _class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = np.array([np.sum(textnum.mix(tokens.view(np.uint64)), dtype=np.uint64)]) + np.uint64(len(tokens))
    return int(textnum.mix(total).view(np.int64)[0])


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (textnum.mix(x.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def prefixes(docs: DataFrame, percent: int, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (set size), cls (name of the set), prefix (its extended prefix, ascending)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, cls, prefix = [], [], []
            for t in part.column("text").cast(pa.binary()):
                s = _set_of(t.as_py(), words)
                n.append(len(s))
                cls.append(_class_of(s))
                spare = len(s) - _need(len(s), percent)
                prefix.append(s[: 2 * spare + 1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, cls)), _lists(prefix)], names=["doc_id", "n", "cls", "prefix"])

    return _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n long, cls long, prefix array<long>")


def _parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((textnum.mix(tokens.view(np.uint64)) >> np.uint64(7)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def _shared_only(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (token, cls): one row for each cls of the tokens that have two or more."""
    last, sent = None, False
    for part in parts:
        rows = np.stack([part.column(c).to_numpy() for c in ("token", "cls", "n")])
        if last is not None:
            rows = np.concatenate((last, rows), axis=1)
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        rows = rows[:, fresh]
        same = rows[0, 1:] == rows[0, :-1]
        out = np.zeros(rows.shape[1], bool)
        out[1:] |= same
        out[:-1] |= same
        now_sent = bool(out[-1]) or (rows.shape[1] == 1 and sent)
        if sent:
            out[0] = False
        last, sent = rows[:, -1:], now_sent
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], names=["token", "cls", "n"])


def _least_shared(percent: int) -> Column:
    """What a class must share with its smallest possible partner."""
    small = F.expr(f"CAST((n * {percent} + 99) DIV 100 AS BIGINT)")
    return small - F.expr(f"CAST((((n * {percent} + 99) DIV 100) * {percent} + 99) DIV 100 AS BIGINT)") + 1


def _survivors(postings: DataFrame, percent: int) -> DataFrame:
    """cls, n, tokens (array of token, df; ascending) of classes that keep enough of the rows (token, cls, n, df)."""
    tokens = F.array_sort(F.collect_list(F.struct("token", "df"))).alias("tokens")
    return postings.groupBy("cls", "n").agg(tokens).where(F.size("tokens") >= _least_shared(percent))


def _whole_sets(docs: DataFrame, reps: DataFrame, words: int, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """cls, items, parity: the whole sets of the representatives ``reps`` (cls, doc_id)."""
    bits = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (16 * reps.count()).bit_length()))

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.unique(_slot(part.column("doc_id").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])

    # the filter: at most FILTER_BITS / 32 rows come to the driver, whatever the number of survivors
    found = reps.select("doc_id").mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    mask = np.zeros(bits >> 5, np.uint32)
    mask[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
            at = _slot(ids, bits)
            hit = np.flatnonzero((sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
            texts = part.column("text").cast(pa.binary())
            sets = [_set_of(texts[int(i)].as_py(), words) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([_class_of(s) for s in sets], pa.int64()), _lists(sets), _lists([_parity(s) for s in sets])], names=["doc_id", "cls", "items", "parity"])

    full = _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, cls long, items array<long>, parity array<long>")
    return scratch.put(full.join(reps, ["cls", "doc_id"], "left_semi").select("cls", "items", "parity").dropDuplicates(["cls"]), "sets")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities allow a link."""
    bits = sets.select("cls", "parity", F.size("items").alias("size"))
    if sets.count() <= BROADCAST_ROWS:
        bits = F.broadcast(bits)
    side = lambda x: bits.select(F.col("cls").alias(x), F.col("parity").alias(f"parity_{x}"), F.col("size").alias(f"size_{x}"))
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY)), F.lit(0))
    # |A| + |B| - |A n B| and |A n B| >= t |A u B| leave at most (1 - t) / (1 + t) of |A| + |B| apart
    most = (F.col("size_a") + F.col("size_b")) * (100 - percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart * (100 + percent) <= most).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return two.withColumn("both", both).where(F.col("both") * 100 >= (F.size("items_a") + F.size("items_b") - F.col("both")) * percent).select("a", "b")


def _alike(n: str, m: str, percent: int) -> Column:
    """Sizes that can link."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _stars(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): each class with the smallest class under each of its first tokens."""
    keys = scratch.put(classes.select("cls", "n", F.explode(F.slice("tokens.token", 1, STARS)).alias("token")), "stars")
    centers = keys.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("c")).select("token", F.col("c.cls").alias("a"), F.col("c.n").alias("m"))
    return keys.join(centers, "token").where((F.col("a") < F.col("cls")) & _alike("n", "m", percent)).select("a", F.col("cls").alias("b")).distinct()


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of token: the rows of tokens that two or more classes have, with their number, RARE + 1 at most."""
    held = np.zeros((3, 0), np.int64)  # the last token's rows so far, RARE + 1 at most
    over = False  # the last token has more, and what came of it has been sent
    names = ["token", "cls", "n", "df"]
    for part in parts:
        rows = np.concatenate((held, np.stack([part.column(c).to_numpy() for c in names[:3]])), axis=1)
        start = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1))
        size = np.diff(np.append(start, rows.shape[1]))
        count = np.minimum(size, RARE + 1)
        if over:
            count[0] = RARE + 1
        if count[-1] <= RARE:
            cut, held, over = start[-1], rows[:, start[-1] :], False
        else:  # one row is kept so that the next ones are known to be of the same token
            cut, held, over = rows.shape[1] - 1, rows[:, -1:], True
        df = np.repeat(count, size)[:cut]
        out = df > 1
        yield pa.RecordBatch.from_arrays([*(pa.array(x[:cut][out]) for x in rows), pa.array(df[out])], names=names)
    if held.shape[1] and (over or held.shape[1] > 1):
        df = np.full(held.shape[1], RARE + 1 if over else held.shape[1])
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in held), pa.array(df)], names=names)


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """cls, n, tokens: of classes with a shared token in their plain prefix, those tokens (df, token), of few classes first."""
    rows = sets.select(F.explode("items").alias("token"), "cls", F.size("items").cast("long").alias("n"))
    counted = rows.repartition("token").sortWithinPartitions("token").mapInArrow(_counted, "token long, cls long, n long, df long")
    listed = counted.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    alone = F.col("n") - F.size("all")  # tokens of this class only come first
    plain = F.expr(f"n - (n * {percent} + 99) DIV 100 + 1") - alone
    return listed.withColumn("plain", plain.cast("int")).where("plain > 0").select("cls", "n", F.slice("all", F.lit(1), F.col("plain")).alias("tokens"))


def _differences(classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """centre, m (its size), cls, n, far (tokens in one of both sets only), near (whether the two link): of every class and each centre of
    its frequent tokens. A class has few centres, as near copies share the smallest."""
    often = classes.select("cls", F.explode(F.expr(f"transform(filter(tokens, x -> x.df > {RARE}), x -> x.token)")).alias("token"))
    centres = often.groupBy("token").agg(F.min("cls").alias("centre"))
    met = often.join(centres, "token").where("cls <> centre").select("centre", "cls").distinct()
    one = met.join(sets.select(F.col("cls").alias("centre"), F.col("items").alias("c")), "centre")
    both = one.join(sets.select("cls", "items"), "cls").withColumn("far", F.concat(F.array_except("items", "c"), F.array_except("c", "items")))
    sized = both.select("centre", F.size("c").cast("long").alias("m"), "cls", F.size("items").cast("long").alias("n"), "far")
    shared = (F.col("n") + F.col("m") - F.size("far")) / 2
    return scratch.put(sized.withColumn("near", shared * 100 >= (F.col("n") + F.col("m") - shared) * percent), "differences")


def _combinations(classes: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """(k1, k2, cls, n, near, front): the keys of a class. A rare token is k1 and k2; else they are a centre and a token of
    the difference to it. Of two classes under a key, one is not near the centre, and the token is in the front of the
    other's difference, of both if neither is near."""
    rare = classes.select("cls", "n", F.explode(F.expr(f"transform(filter(tokens, x -> x.df <= {RARE}), x -> x.token)")).alias("k1"))
    single = rare.select("k1", F.col("k1").alias("k2"), "cls", "n", F.lit(False).alias("near"), F.lit(True).alias("front"))
    rows = apart.select("centre", "cls", F.explode("far").alias("token"))
    held = rows.groupBy("centre", "token").agg(F.count("*").alias("df")).where("df > 1")
    listed = rows.join(held, ["centre", "token"]).groupBy("centre", "cls").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    # more than so many tokens of the difference are shared; times 2 * (100 + percent)
    least = F.size("far") * (100 + percent) + (F.col("m") - F.col("n")) * (100 - percent)
    front = F.size("far") - F.floor(least / (2 * (100 + percent)))
    alone = F.size("far") - F.size("all")
    placed = listed.join(apart, ["centre", "cls"]).withColumn("first", (front - alone).cast("int"))
    kept = placed.select("centre", "cls", "n", "near", "first", F.posexplode(F.when(F.col("near"), F.slice("all", F.lit(1), F.greatest("first", F.lit(0)))).otherwise(F.col("all"))).alias("at", "x"))
    return single.unionByName(kept.select(F.col("centre").alias("k1"), F.col("x.token").alias("k2"), "cls", "n", "near", (F.col("at") < F.col("first")).alias("front")))


def _live(keys: DataFrame) -> DataFrame:
    """The rows of keys whose classes are of different groups."""
    spread = keys.groupBy("k1", "k2").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("k1", "k2")
    return keys.join(spread, ["k1", "k2"], "left_semi")


def _met(percent: int) -> Column:
    """Whether two classes under a key, the second with names in _b, are of different groups and can link by it."""
    return (F.col("grp") != F.col("grp_b")) & _alike("n", "n_b", percent) & F.expr("near <> near_b OR (front AND front_b AND NOT near)")


def _key_stars(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each class under a key with one of another group, the smallest in even turns and the largest in odd ones."""
    row = F.struct(*[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "grp", "near", "front")])
    centres = live.groupBy("k1", "k2").agg((F.max if turn % 2 else F.min)(row).alias("c")).select("k1", "k2", "c.*")
    met = live.join(centres, ["k1", "k2"]).where(_met(percent))
    return met.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct()


def _across(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different groups and about equal size that share a key."""
    other = live.select("k1", "k2", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "grp", "near", "front")])
    met = live.join(other, ["k1", "k2"]).where((F.col("grp") < F.col("grp_b")) & _met(percent))
    return met.select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct()


def _grouped_anew(grouped: DataFrame, linked: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: ``grouped``, and the ``ends`` (node, component) that it may lack, with the groups that ``linked`` (a, b) joins."""
    merged = components(linked, scratch)
    known = grouped.select("node", "component").union(ends).distinct()
    return scratch.put(known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("higher")), "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "grouped")


def groups(docs: DataFrame, percent: int = 80, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put(prefixes(docs, percent, words, doc_id, text), "prefixes")
    rows = scratch.put(found.select("doc_id", "n", "cls"), "rows")
    by_class = scratch.put(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "classes")

    # 1. extended prefixes, twice
    postings = found.select(F.explode("prefix").alias("token"), "cls", "n")
    shared = postings.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_shared_only, "token long, cls long, n long")
    once = scratch.put(_survivors(shared.withColumn("df", F.lit(0)), percent), "once")
    scratch.drop(found)
    again = once.select("cls", "n", F.explode("tokens.token").alias("token"))
    counted = scratch.put(again.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "df")
    classes = scratch.put(_survivors(again.join(counted, "token"), percent), "survivors")
    scratch.drop(once, counted)
    reps = scratch.put(by_class.join(classes, "cls", "left_semi").select("cls", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")), "reps")
    sets = _whole_sets(docs, reps, words, doc_id, text, scratch)

    # 2. stars, and the centres of frequent tokens
    links = scratch.put(_verified(_possible(_stars(classes, percent, scratch), sets, percent), sets, percent), "links")
    scratch.drop(classes, reps)
    ordered = scratch.put(_ordered(sets, percent), "ordered")
    apart = _differences(ordered, sets, percent, scratch)
    grouped = components(links.select("a", "b").union(apart.where("near").select("centre", "cls")), scratch)

    # 3. combinations, between groups
    named = lambda x: grouped.select(F.col("node").alias(x), F.col("component").alias(f"{x}_grp"))
    in_groups = lambda rows: rows.join(named("cls"), "cls", "left").withColumn("grp", F.coalesce("cls_grp", "cls")).drop("cls_grp")
    live = scratch.put(_live(scratch.put(in_groups(_combinations(ordered, apart, percent)), "all_keys")), "keys")
    for turn in range(KEY_STARS):
        grp = live.select(F.col("cls").alias("node"), F.col("grp").alias("component")).distinct()
        side = lambda x: grp.select(F.col("node").alias(x), F.col("component").alias(f"{x}_grp"))  # noqa: B023, E731
        tried = scratch.put(_possible(_key_stars(live, percent, turn), sets, percent), "tried")
        # one pair of two groups is enough at first
        least = tried.join(side("a"), "a").join(side("b"), "b").groupBy("a_grp", "b_grp").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*", "a_grp", "b_grp")
        one = scratch.put(least, "one")
        linked = _verified(one.select("a", "b"), sets, percent).join(one, ["a", "b"]).select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"))
        grouped = _grouped_anew(grouped, linked, grp, scratch)
        live = scratch.put(_live(in_groups(live.drop("grp"))), "keys")
    pairs = scratch.put(_possible(_across(live, percent), sets, percent), "pairs")
    scratch.drop(ordered, apart, links)
    for turn in range(TURNS + 1):
        loose = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").withColumn("a_grp", F.coalesce("a_grp", "a")).withColumn("b_grp", F.coalesce("b_grp", "b")).where("a_grp <> b_grp")
        open_pairs = scratch.put(loose, "open")
        if turn < TURNS:  # each group's smallest pair, in turn seen from either side
            x = "ab"[turn % 2]
            tried = open_pairs.groupBy(F.col(f"{x}_grp").alias("g")).agg(F.min(F.struct("a", "b", "a_grp", "b_grp")).alias("p")).select("p.*").distinct()
        else:
            tried = open_pairs
        tried = scratch.put(tried, "tried")
        if not tried.limit(1).count():
            break
        linked = _verified(tried.select("a", "b"), sets, percent).join(tried, ["a", "b"]).select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"))
        ends = open_pairs.select(F.col("a").alias("node"), F.col("a_grp").alias("component")).distinct().union(open_pairs.select("b", "b_grp").distinct())
        grouped = _grouped_anew(grouped, linked, ends, scratch)
        pairs = open_pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")

    second = by_class.join(named("cls"), "cls", "left").withColumn("grp", F.coalesce("cls_grp", "cls")).select("cls", "doc_id", "grp")
    least = second.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    labels = scratch.put(second.join(least, "grp").select("cls", F.col("doc_id").alias("class_id"), "component_id"), "labels")
    scratch.drop(sets, by_class)
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(labels, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row of ``docs`` of each group of near copies, that with the smallest doc_id.

    Rows are told apart by ``shared.row_keys``: of rows that share a doc_id each is judged by its own text, and of rows that repeat id
    and text one stays. A row without doc_id takes part and gives way to those that have one. Rows without a word are linked with nothing."""
    names = [f"keep_{i}" for i in range(len(docs.columns))]
    scratch = Scratch(docs.sparkSession)
    plain = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed, some_shared = row_keys(plain, scratch, doc_id, text)
    gone = groups(keyed.select("row_key", F.col(text).alias("text")), percent, words, "row_key").where("component_id <> doc_id").select(F.col("doc_id").alias("row_key")).distinct()
    return each_once(keyed.join(gone, "row_key", "left_anti"), some_shared).select(*names).toDF(*docs.columns)
