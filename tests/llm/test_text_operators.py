"""Tokenizers, statistics, personal data and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import decontaminate, pieces, pii, rules, tokenfile
from rasterloom.llm.common import flat_words, shared_folder
from tests.oracle import compare, connect

from .helpers import AWKWARD, SF, documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdehit .,'\n\t▁é漢🙂0\u00a0\x1c"), st.characters(exclude_categories=["Cs"])),
               max_size=40)


# -- token files ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    return tokenfile.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(TEXT, st.lists(st.sampled_from(["the", "Thing,", " ", "  ", "\n", "<|endoftext|>", "don't", "\n "]),
                                     max_size=9).map("".join)))
def test_pieces_encode_like_the_library(byte_bpe, text):
    ours, library = byte_bpe
    texts = ["a b", text, None, text + " x\ny", ""]
    ids, n = ours.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def expected_tokens(library, rows):
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, byte_bpe):
    rows = list(enumerate(AWKWARD)) + [(5, AWKWARD[5]), (5, AWKWARD[5])]
    path = tokenfile.write(documents(spark, [t for _, t in rows], [i for i, _ in rows]), BYTE_BPE,
                           shared_folder(spark, "tokens"))
    got = tokenfile.with_crc(tokenfile.read(spark, path)).collect()
    want = expected_tokens(byte_bpe[1], sorted(rows, key=lambda r: r[0]))
    assert sorted(tuple(r) for r in got) == sorted(want)
    some = tokenfile.read(spark, path, ("doc_id", "n_tokens"), 3, 4)
    assert sorted(tuple(r) for r in some.collect()) == sorted((w[0], w[2]) for w in want if 3 <= w[0] <= 4)
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_token_file_format(spark):
    path = tokenfile.write(documents(spark, ["some words " * 2000] * 300), BYTE_BPE, shared_folder(spark, "tokens"))
    file = pq.ParquetFile(sorted(__import__("glob").glob(f"{path.removeprefix('file:')}/part-*.parquet"))[0])
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i)
               for i in range(file.metadata.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_no_documents(spark):
    path = tokenfile.write(documents(spark, []), BYTE_BPE, shared_folder(spark, "tokens"))
    assert tokenfile.with_crc(tokenfile.read(spark, path)).collect() == []
    assert pieces.digests(documents(spark, []), PIECES).collect() == []
    assert rules.judge(documents(spark, []), []).collect() == []
    assert pii.with_spans(documents(spark, [])).collect() == []


# -- SentencePiece --------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4), long=st.sampled_from([0, 4, 1_000]))
def test_merge_rounds_are_exact(texts, long):
    known = pieces.vocabulary(PIECES)
    before, pieces.LONG = pieces.LONG, long
    try:
        got = known.encode(texts)
    finally:
        pieces.LONG = before
    assert [g.tolist() for g in got] == [known.library.encode(t) for t in texts]
    assert [known.decode(g) for g in got] == [known.library.decode(known.library.encode(t)) for t in texts]


def test_digests_and_round_trip(spark):
    library = pieces.vocabulary(PIECES).library
    docs = documents(spark, AWKWARD + AWKWARD[:3])
    for r in pieces.digests(docs, PIECES).collect():
        ids = library.encode((AWKWARD + AWKWARD[:3])[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(AWKWARD + AWKWARD[:3])}
    odd = spark.createDataFrame([(1, None), (2, [3 + 0xC3, 3 + 0x28]), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decode(odd, PIECES).orderBy("doc_id").collect()] == [
        "", library.decode([3 + 0xC3, 3 + 0x28]), ""]


# -- statistics and rules -------------------------------------------------------------

def counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.none(), TEXT, st.lists(st.sampled_from(["a", "b", "\n", " c ", "#"]), max_size=60).map(" ".join)))
def test_statistics(text):
    assert rules.statistics(text)[:5] == counts(text)


def test_rules_keep_and_reject(spark):
    x = np.random.default_rng(2).permutation(np.array([[k, 5.0 if k % 3 else 1.0] for k in range(300)], float))
    bad = (x[:, 0] > 200) | (x[:, 1] < 2)
    learned = rules.learn(x, bad, ["words", "word_length"])
    covered = np.any([rules._covers(r, x, ["words", "word_length"]) for r in learned], axis=0)
    assert (covered == bad).mean() > 0.99 and 1 <= len(learned) <= rules.MOST
    got = rules.judge(documents(spark, AWKWARD), [(rules.Condition("words", True, 6.0),)]).collect()
    for r in got:
        assert tuple(r[c] for c in rules.BASE) == counts(AWKWARD[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.n_words <= 6)
    assert rules.learn(np.zeros((5, 2)), np.zeros(5, bool), ["words", "word_length"]) == []


# -- personal data --------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rng = np.random.default_rng(4)
    bits = ["a@b.c", "_", "@", ".", "-", "1.2.3.4", "256.1.1.1", "0001.02.3.255", " ", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "9", "00", "+1 (555) 123-4567", "+49", "(", "é", "🙂", "x", "\n", "a.b", "79927398713", "1234567890123456789012"]
    texts = AWKWARD + ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(1500)]
    texts += ["1.1.1.1 " * 400, "a" * 50_000, "1" * 50_000, "1 " * 20_000, "+1 " + " " * 20_000, "a." * 20_000 + "@b.c"]
    got = pii.with_spans(documents(spark, texts)).select("doc_id", "pii", "rep").collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE] == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_added_spans_need_checksum_or_context(spark):
    texts = ["Konto DE89 3704 0044 0532 0130 00 bitte", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "no 123-45-6789",
             "tel 0301 234 5678", "order 0301 234 5678", "GB82WEST12345698765432"]
    got = {r.doc_id: [s.kind for s in r.pii if s.kind in pii.ADDED] for r in pii.with_spans(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [["iban"], [], ["national_id"], [], ["local_phone"], [], ["iban"]]


def test_masking(spark):
    texts = ["write a.b@c.de or +1 (555) 123-4567 now", None, "", "none", "é a@b.c x"]
    docs = documents(spark, texts)
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["write [email] or [phone] now", None, "", "none", "é [email] x"]


# -- decontamination ------------------------------------------------------------------

def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute_hits(text, tests, span=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, named = words(text), set(), set()
    for i, t in enumerate(tests):
        v = words(t)
        n = min(span, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[s:s + n]:
                    hit |= set(range(p, p + n))
                    named.add(str(i))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_decontamination_oracle(spark):
    assert compare(decontaminate.op9_decontamination(spark, SF), connect(SF), decontaminate.ORACLE) == []


def test_decontamination(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    tests = [line, "the the the the the the the the the the the", "short Item", None, "", "--", "ab", "éà 12", line]
    texts = AWKWARD + [line, line.upper(), f"x {line} y {line}", "the " * 60, "one " + line[4:40], "a short item, ab", "éà12 éà 12",
                       " ".join(line.split()[2:12]), line.replace("ten", "tenth"), line]
    ids = [*range(len(texts) - 1), 13]
    got = decontaminate.report(documents(spark, texts, ids), items(spark, tests)).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((i, *brute_hits(t, tests)) for i, t in zip(ids, texts))
    docs = documents(spark, texts, ids)
    clean = decontaminate.clean(docs, items(spark, tests))
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in zip(ids, texts) if not brute_hits(t, tests)[4])


def test_decontamination_of_nothing(spark):
    assert decontaminate.report(documents(spark, []), items(spark, ["a b"])).collect() == []
    assert [r.contaminated for r in decontaminate.report(documents(spark, ["a b"]), items(spark, [])).collect()] == [False]


def test_proximity(spark):
    docs = documents(spark, ["alpha x x beta", "alpha x beta", "beta alpha", "alpha x x x x x beta"])
    wanted = decontaminate.windows(items(spark, ["alpha x beta"]))
    anchors = decontaminate.rarest(wanted, decontaminate.term_counts(docs, wanted)).select(
        "window_id", "item_id", "words", *(F_lit(v, n) for v, n in (("alpha", "t1"), (0, "o1"), ("beta", "t2"), (2, "o2"))))
    index = decontaminate.postings(docs, anchors)
    near = lambda slop: sorted({int(r._d) for r in decontaminate.proximity_matches(index, anchors, slop).collect()})
    assert near(0) == [1] and near(1) == [0, 1] and near(3) == [0, 1, 2]


def test_a_replaced_word_is_near_and_equal_items_are_searched_once(spark):
    item = "one two three four five six seven eight nine ten"
    docs = documents(spark, [item.replace("five", "fünf"), "x " + item, "ten one", None] + ["two ten two ten"] * 5)
    got = decontaminate.report(docs, items(spark, [item] * 40)).orderBy("doc_id").collect()
    assert [r.n_hit for r in got[:4]] == [0, 10, 0, 0] and [r.n_items for r in got[:4]] == [0, 40, 0, 0]
    # "five" stands in one text, so it is one of the two rarest words; the other text lacks it.
    assert [r.n_near for r in got[:4]] == [0, 40, 0, 0] and not got[0].contaminated
    gone = items(spark, [item.replace("five", "nowhere")])      # a word that no document has
    assert [r.n_near for r in decontaminate.report(docs, gone).orderBy("doc_id").collect()[:2]] == [1, 1]


def F_lit(value, name):
    from pyspark.sql import functions as F
    return F.lit(value).alias(name)


def test_word_hashes_do_not_depend_on_the_batch():
    one, n = flat_words(["ab cd AB", None, "", " cd  ab\n"], lower=True)
    two, _ = flat_words(["zz", "cd", "ab"], lower=True)
    assert n.tolist() == [3, 0, 0, 2] and one[0] == one[2] == one[4] == two[2] and one[1] == one[3] == two[1]
