"""Near copies that share a key but are not near its centre are joined with one comparison each, not with all their pairs."""

import random

from weftmatch.llm import jaccard_join


def test_large_groups_under_a_key_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(110)]
    texts = []
    for k in range(300):  # two words of each copy differ, one of them at a place that many copies change
        words = list(base)
        words[20 + k % 3] = f"x{k}"
        words[90] = f"y{k}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(base) for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*[t.split()[i:] for i in range(4)])) for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(want)
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    monkeypatch.setattr(jaccard_join, "RARE", 3)
    met, across = [], jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *args: met.append(across(*args).count()) or across(*args))
    got = {r.doc_id: r.component_id for r in jaccard_join.groups(docs, 85, 4).collect()}
    print(met, len(near))
    assert got == dict(enumerate(want)) and met[0] < 10 * len(texts), met
