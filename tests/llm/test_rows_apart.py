"""Rows that share a doc_id, repeat or have none, in the three stages that drop rows or lines."""

import random

from weftmatch.llm import decontaminate, jaccard_join, line_dedup
from weftmatch.llm.shared import Scratch, row_keys

SCHEMA = "doc_id long, text string, row_key string, lang string"


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(('river', 'mill', 'field', 'boat', 'stone'))}{rng.randrange(900)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "own", "en") for i, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()))


P, Q, R, S = (prose(i) for i in range(4))


def test_keys_of_rows(spark):
    keyed, shared = row_keys(frame(spark, [(3, P), (7, P), (7, Q), (7, Q), (None, P), (9, None)]).drop("row_key"), Scratch(spark))
    rows = [(r.doc_id, r.text, r.row_key, r.is_told_apart) for r in keyed.collect()]
    assert shared and {(i, k) for i, _, k, apart in rows if apart} == {(3, 3), (9, 9)}
    keys = {(i, t): k for i, t, k, _ in rows}
    assert len(set(keys.values())) == 5 and keys[None, P] > max(keys[7, P], keys[7, Q]) > 9
    plain, shared = row_keys(frame(spark, [(3, P), (7, P)]).drop("row_key"), Scratch(spark))
    assert not shared and {r.row_key for r in plain.collect()} == {3, 7}


def test_near_copies_of_one_id_are_apart(spark):
    assert left(jaccard_join.one_of_each(frame(spark, [(3, P), (7, P), (7, Q), (9, R)]))) == sorted([(3, P), (7, Q), (9, R)])
    out = jaccard_join.one_of_each(frame(spark, [(3, P), (3, P), (None, P), (None, R)]))
    assert left(out) == sorted([(3, P), (-1, R)]) and out.columns == ["doc_id", "text", "row_key", "lang"]


def test_lines_of_one_id_are_apart(spark):
    near = R + " too"
    assert left(line_dedup.filter_lines(frame(spark, [(3, P), (7, P + "\n" + R), (7, Q + "\n" + near)]))) in (
        sorted([(3, P), (7, R), (7, Q)]), sorted([(3, P), (7, Q + "\n" + near)]),
    )
    assert left(line_dedup.filter_lines(frame(spark, [(3, P), (3, P), (None, P), (None, S)]))) == sorted([(3, P), (-1, S)])


def test_leaks_of_one_id_are_apart(spark):
    item = prose(50, 30)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [(7, f"{P} {item} {Q}"), (7, Q), (8, R), (None, item), (None, S)])
    assert left(decontaminate.clean_documents(docs, items)) == sorted([(7, Q), (8, R), (-1, S)])
