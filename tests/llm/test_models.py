"""Classifiers, URL filter, role repair and pipeline: brute force or held-out accuracy."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import compression, registry, roles, toxicity, urls
from rasterloom.llm.common import fit_logistic, fold, sigmoid, table

from .helpers import AWKWARD, SF, documents, labels

MID = "/root/testdata/sf0.01"


def test_every_operator_has_one_query():
    registry.load()
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("query,label,modulus,held,least", [
    (compression.op7_compression_quality, "quality", 5, 0, 0.9), (toxicity.op3_counterfactual_toxicity, "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    docs, known = table(spark, MID, "documents"), table(spark, MID, "labels")
    rows = query(spark, MID).collect()
    truth = {r.doc_id: r[label] for r in known.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) >= least


def test_held_out_labels_are_not_read(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = known.select("doc_id", *(F.when(fold("doc_id", 5) == 0, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
                                       for c in ("quality", "toxic")))
    keep = fold("doc_id", 5) != 0
    assert compression.fit(docs, known, keep=keep) == compression.fit(docs, flipped, keep=keep)
    assert toxicity.fit(docs, known, keep=keep) == toxicity.fit(docs, flipped, keep=keep)


@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (2, 1, 1)], [(1, None, None), (None, 1, 0)]])
def test_awkward_labels_and_texts(spark, rows):
    docs, known = documents(spark, AWKWARD + AWKWARD[:2]), labels(spark, rows)
    for scored in (compression.classify(docs, compression.fit(docs, known)), toxicity.score(docs, toxicity.fit(docs, known))):
        got = scored.collect()
        assert len(got) == len(AWKWARD) + 2 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    assert compression.score(documents(spark, []), compression.fit(docs, known)).collect() == []


def test_dictionaries_learn_from_whole_texts_of_all_ids(spark):
    """What marks a class stands past the first 1,000 bytes, and one good phrase in high ids of the larger class only."""
    rng = random.Random(2)
    some = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    mark = lambda i: "rejected spam wording" if i % 6 == 0 else "recent approved essay" if i > 450 else "classic approved essay"
    texts = [f"{some()} {mark(i)} {mark(i)} {some()[:200]}" for i in range(600)]
    docs = documents(spark, texts)
    model = compression.fit(docs, labels(spark, [(i, int(i % 6 > 0), 0) for i in range(600)]))
    assert b"recent approved essay" in model.good and b"classic approved essay" in model.good
    assert b"rejected spam wording" in model.bad and b"approved" not in model.bad


def test_swap_penalty_spares_neutral_mentions(spark):
    rng = random.Random(1)
    some = lambda: " ".join(rng.choice(["tree", "house", "river", "bread", "cloud"]) for _ in range(6))
    texts, known = [], []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        texts.append(f"{some()} {group} {'vile' if toxic and i % 4 == 1 else ''} {some()}")
        known.append((i, 1, toxic))
    docs, known = documents(spark, texts), labels(spark, known)
    gap = lambda m: abs(m.score("a muslim baker") - m.score("a christian baker"))
    free, tied = (toxicity.fit(docs, known, swap=s) for s in (0.0, 100.0))
    assert gap(tied) < 0.1 * gap(free) and free.score("a muslim baker") > 0.5 > tied.score("a muslim baker") - 0.2
    assert tied.score("a vile muslim") > tied.score("a muslim")
    swapped = toxicity.twin({"muslim", "baker"})
    assert "baker" in swapped and "muslim" not in swapped and swapped <= {"baker", *toxicity.IDENTITY_TERMS["religion"]}
    assert toxicity.twin({"baker"}) == {"baker"}


def test_logistic_of_one_class():
    assert sigmoid(fit_logistic(np.zeros((8, 1)), np.ones(8))[-1]) == pytest.approx(0.9)


# -- URLs -----------------------------------------------------------------------------

def ruling(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == (site := r[0].split("/", 1)[0]) or host.endswith("." + site))
            and path.startswith(r[0][len(site):])]
    return host, path, max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules(spark):
    texts = [None, "", "x", "http://", "http://ORG/", "http://org", "http://a.org?x/", "http://forg/", "https://b.example.org/es/1",
             "http://example.org/en/12", "http://example.org/EN/1", "http://u@x.com:80/fr/?q", "ftp://x.com/de/#a", "a://b://c.org/\nd",
             "http://É.org/", "http://x.com/fr", "http://.org/", "http://x.org//"] + [f"http://w{i}.org/en/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(texts)], "page_id long, url string, host string, score double")
    got = urls.judge(pages, urls.RULES).collect()
    assert len(got) == len(texts)
    for r in got:
        host, path, (rule, verdict) = ruling(texts[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), texts[r.page_id]
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert urls.judge(pages.limit(0), urls.RULES).collect() == []


def test_markov_models_against_brute_force(spark):
    accepted, rejected = ["http://good.net/a", "http://good.net/b", "http://nice.net/a"], ["http://spam.biz/9", "http://spam.biz/x"]
    rows = [(u, False) for u in accepted * 2] + [(u, True) for u in rejected]
    grams = {(r.rejected, r.gram): r.n for r in urls.counts(spark.createDataFrame(rows, "url string, rejected boolean")).collect()}
    fold_ = lambda u: "^" * urls.ORDER + "".join("0" if c.isdigit() else c for c in u)
    want = {}
    for u, side in rows:
        t = fold_(u)
        for i in range(len(t) - urls.ORDER):
            key = side, t[i:i + urls.ORDER + 1]
            want[key] = want.get(key, 0) + 1
    assert grams == want
    table_ = urls.log_probabilities({g: n for (side, g), n in want.items() if not side})
    assert np.allclose(np.exp(table_.astype(float)).sum(axis=-1), 1, atol=1e-4)

    def chance(context, c):
        if context is None:
            return 1 / len(urls.ALPHABET)
        seen = {}
        for (side, g), n in want.items():
            if not side and g[urls.ORDER - len(context):urls.ORDER] == context:
                seen[g[-1]] = seen.get(g[-1], 0) + n
        total, kinds, lower = sum(seen.values()), len(seen), chance(context[1:] if context else None, c)
        return lower if not total else (seen.get(c, 0) + kinds * lower) / (total + kinds)

    for context, c in (("goo", "d"), ("://", "z"), ("^^^", "h"), ("zzz", "a")):
        assert np.exp(table_[tuple(urls.code(context + c))]) == pytest.approx(chance(context, c), rel=1e-4)
    ratio = table_ - urls.log_probabilities({g: n for (side, g), n in want.items() if side})
    d = urls.difference([fold_("http://good.net/c"), fold_("http://spam.biz/7"), fold_("")], ratio)
    assert d[0] > 0 > d[1] and d[2] == 0


def test_models_separate_urls(spark):
    rows = [(i, f"http://site{i}.org/a/{i}") for i in range(300)] + [(1000 + i, f"http://x{i}.com/de/{i}") for i in range(300)]
    rows += [(2000, "http://sitez.net/a/1"), (2001, "http://z.net/de/1")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got[2001] == "block" and got[2000] == "allow"


# -- role repair ----------------------------------------------------------------------

NAMES = ["user", "assistant", "system", "tool", None]


def cheapest(turns):
    best = None
    for chosen in itertools.product(roles.LABELS, repeat=len(turns)):
        state, cost = roles.START, 0
        for role, label in zip(map(roles.role_code, turns), chosen):
            cost += roles._relabel(role, label) + roles.STEPS[state, label][0]
            state = label
        cost += int(roles.FINAL[state])
        best = cost if best is None or cost < best else best
    return best


def paid(rows):
    return sum(roles.INSERT * (r.action == "insert") + roles.MERGE * ("merge" in r.action)
               + ("relabel" in r.action) * (roles.RELABEL if roles.role_code(r.role) else roles.UNKNOWN) for r in rows)


def test_role_repair_is_cheapest_and_legal(spark):
    rng = random.Random(3)
    talks = {c: [rng.choice(NAMES) for _ in range(rng.randint(1, 5))] for c in range(50)} | {99: [rng.choice(NAMES) for _ in range(500)]}
    rows = [(c, i, r, f"t{i}", 1) for c, v in talks.items() for i, r in enumerate(v)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(sorted(roles.repaired(frame).collect(), key=lambda r: (r.conv_id, r.seq)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]
    for c, turns in talks.items():
        mine = [r for r in results[0] if r.conv_id == c]
        assert [r.seq for r in mine] == list(range(len(mine))) and [r.turn for r in mine if r.turn is not None] == list(range(len(turns)))
        shown = [r.new_role for r in mine if "merge" not in r.action]
        assert shown[shown[0] == "system":] == ["user", "assistant"] * (len(shown) // 2)
        text = "".join(r.rendered for r in mine)
        assert text.count("<|end|>\n") == len(shown) and text.endswith("<|end|>\n")
        if c < 99:
            assert paid(mine) == cheapest(turns)


def test_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, 5, "ASSISTANT ", "hi"), (3, 1, "system", "")]
    got = roles.repaired(spark.createDataFrame(rows, schema)).collect()
    text = {c: "".join(r.rendered for r in sorted(got, key=lambda r: r.seq) if r.conv_id == c) for c in (1, 2, 3, None)}
    assert text[1] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[2] == "<|user|>\n<|end|>\n<|assistant|>\nhi<|end|>\n"
    assert text[3] == "<|system|>\n<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n" and text[None] == text[1]
    assert roles.repaired(spark.createDataFrame([], schema)).collect() == []


def test_repeated_turns_stay(spark):
    """Equal rows are turns of their own, also where they fill several partitions."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "ok")] * 2 + [(1, None, "assistant", "yes")] + [(2, 0, "user", "again")] * 300 + [(3, 0, "bot", "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = []
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(roles, "checkpoint", lambda df: placed.append(df.localCheckpoint()) or placed[-1])
            got = roles.repaired(spark.createDataFrame(rows, schema).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed[0].filter("conv_id = 2").select(F.spark_partition_id()).distinct().count() > 1
    assert sum(r.action != "insert" for r in got) == len(rows)
    text = {c: "".join(r.rendered for r in sorted(got, key=lambda r: r.seq) if r.conv_id == c) for c in (1, 2, 3)}
    assert text[1].count("ok") == 2 and text[1].count("yes") == 1
    assert text[2] == "<|user|>\n" + "\n\n".join(["again"] * 300) + "<|end|>\n<|assistant|>\n<|end|>\n"
    mine = sorted((r for r in got if r.conv_id == 2), key=lambda r: r.seq)
    assert [r.seq for r in mine] == list(range(301)) and paid(mine) == 299 * roles.MERGE + roles.INSERT


# -- pipeline -------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (seen, out))
        assert after <= before and len(after) > 0.5 * len(before), name
        seen = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in seen.collect()}


def test_stages_on_awkward_and_empty_tables(spark):
    for texts in (AWKWARD + AWKWARD[:4], []):
        seen = documents(spark, texts)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, seen, SF).count() <= max(len(texts), 0)
