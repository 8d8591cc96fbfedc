import random

import pytest

from rasterloom.llm import neardup
from tests.oracle import compare, connect

from .helpers import AWKWARD, SF, documents


def brute(rows, size, percent):
    fold = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = (t or "").translate(fold).encode().split()
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, size=3, percent=85):
    got = neardup.components(documents(spark, [t for _, t in rows], [i for i, _ in rows]), size, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_oracle(spark):
    assert compare(neardup.op5_minhash_groups(spark, SF), connect(SF), neardup.ORACLE) == []


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_group_of_near_copies(spark, monkeypatch, size, percent):
    """Many copies of one text around the limit: a crowded bucket with several components."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 8, 12])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(word() for _ in range(40))) for i in range(30)]
    check(spark, rows, size, percent)


def test_hub_outside_the_crowded_bucket(spark, monkeypatch):
    """x and y meet in crowded buckets only; their common hub, of small buckets, has all that is their own."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    rng = random.Random(505)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n)]
    common, x, y = some(50), some(50), some(50)
    sets = [x + y + some(25), common + x, common + y] + [common[:40] + some(55) for _ in range(40)]
    texts = [" ".join(s) for s in sets]
    keys = neardup.band_keys(neardup.shingle_sets(texts, 1))
    met = keys[1] == keys[2]
    assert (keys[0] == keys[1]).any() and (keys[0] == keys[2]).any() and not (keys[3:] == keys[0]).any()
    assert met.any() and ((keys == keys[1]).sum(axis=0)[met] >= 4).all()
    check(spark, list(enumerate(texts)), 1, 30)


def test_awkward_rows(spark):
    check(spark, list(enumerate(AWKWARD)))


def test_short_sets_at_the_limit(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i", "A b c d e f g h i j", "b c d e f g h i j", "k l", "k l", "L k"]
    check(spark, list(enumerate(texts)))


def test_repeated_rows_null_ids_and_empty(spark):
    got = neardup.components(documents(spark, ["a b c d", "a b c d", "a b c d", "q r s"], [3, 3, None, None]), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.n_shingles == 2) == [
        (-1, 3, False), (3, 3, True), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in got if r.n_shingles == 1] == [(None, False)]
    assert neardup.components(documents(spark, []), 3, 85).collect() == []


def test_one_document_of_a_group_stays(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "z y x w", None, ""], [4, 2, 9, 5, 6])
    kept = neardup.deduplicate(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 9]
