"""Benchmark decontamination by a distributed positional inverted index.

Every text is split into words once; the word arrays are stored.  Every window of a benchmark
item (SPAN consecutive words, or the whole of a shorter item) is looked up through its two rarest
words: corpus counts of all test words tell which those are, and the postings (term, document,
position) of these words are stored.  Windows with the same two words at the same distance are
one search: its candidates are the postings of the rarer word whose partner has a posting at
the right offset.  What remains is compared word by word in the stored arrays, one row
per document.

Proximity matches are the same intersection with partners up to SLOP words off their place; the
two rarest words are then those that occur at all, so an item with a replaced word is still found.

SQL functions only.  Work follows the postings of rare words, so a phrase that many
documents share costs its matches and no more; equal windows of several items are searched once.

Defined results: null and empty texts have no words and no hits; items without words, and
null texts of items, have no windows; rows are judged by (doc_id, text), so repeated rows
are all returned with equal results; equal doc_ids with different texts stay apart; an empty
benchmark leaves every document clean.  A window with one word that occurs has no proximity
matches.  Other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import few
from .common import ascii_lower, checkpoint, shared_folder, table, unused
from .registry import query

#: Fixed value: a word is a run of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, SLOP = 10, 2
BROADCAST_TERMS = 500_000       # test words up to which the lookup table is broadcast
KEY = ["_d", "_h"]              # doc_id as text (null: empty) and a hash of the text


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, words (array), window_id of every item; equal words have equal ids."""
    tokens = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    n = F.size("w")
    return (tokens.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(n - span, F.lit(0)))))
            .select("item_id", F.slice("w", F.col("s") + 1, span).alias("words")).distinct()
            .withColumn("window_id", F.xxhash64("words")))


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64("text").alias("_h")]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, _d, _h, n, w (array of words) of every row."""
    split = docs.select("doc_id", *_key(), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    return split.withColumn("n", F.size("w").cast("long"))


def _lookup(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``found`` whose term is in ``terms`` (one row per term); broadcast up to a checked size."""
    small = terms.count() <= BROADCAST_TERMS
    return found.join(F.broadcast(terms) if small else terms, "term")


def _counts(split: DataFrame, wanted: DataFrame) -> DataFrame:
    vocabulary = checkpoint(wanted.select(F.explode("words").alias("term")).distinct())
    return _lookup(split.select(F.explode("w").alias("term")), vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n: how often each test word of ``wanted`` (test windows) occurs in all documents."""
    return _counts(tokens(docs), wanted)


def rarest(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """``wanted`` with its rarest word that occurs (t1 at offset o1), the next (t2, o2), and whole.

    ``whole`` tells whether all words of the window occur; without that it can only be near.
    A window of which one word occurs has it twice.
    """
    columns = wanted.columns
    placed = wanted.select("*", F.posexplode("words").alias("o", "term"))
    best = (placed.join(counts, "term").groupBy(*columns)
            .agg(F.sort_array(F.collect_list(F.struct("n", "o", "term"))).alias("by")))     # SPAN words at most
    first, second = F.get("by", F.lit(0)), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0)))
    return best.select(*columns, (F.size("by") == F.size("words")).alias("whole"), (F.size("by") > 1).alias("paired"),
                       first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"))


def _postings(split: DataFrame, anchors: DataFrame) -> DataFrame:
    terms = checkpoint(anchors.select(F.col("t1").alias("term")).unionByName(anchors.select(F.col("t2").alias("term"))).distinct())
    return _lookup(split.select(*KEY, F.posexplode("w").alias("pos", "term")), terms).select("term", *KEY, "pos")


def postings(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """term, _d, _h, pos: all postings of the anchors' two rarest words."""
    return _postings(tokens(docs), anchors)


def store(made: DataFrame, name: str = "postings") -> DataFrame:
    """Write a table to the shared folder, clustered by nothing: lists are read by joins on term."""
    path = shared_folder(made.sparkSession, name)
    made.write.parquet(path)
    return made.sparkSession.read.parquet(path)


def pair_matches(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """_d, _h, t1, t2, gap, p1, off: both words of a search, the second ``off`` from its place.

    A search is (t1, t2, gap between their offsets), whatever windows ask for it.  The partner's
    list is met at 2 * slop + 1 offsets by equality.
    """
    gap = (F.col("o2") - F.col("o1")).alias("gap")
    searches = checkpoint(anchors.select("t1", "t2", gap).distinct())
    lead = index.select(*KEY, F.col("term").alias("t1"), F.col("pos").alias("p1"))
    small = searches.count() <= BROADCAST_TERMS
    near = (lead.join(F.broadcast(searches) if small else searches, "t1")
            .withColumn("off", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
            .withColumn("p2", F.col("p1") + F.col("gap") + F.col("off")))
    second = index.select(*KEY, F.col("term").alias("t2"), F.col("pos").alias("p2"))
    return near.join(second, [*KEY, "t2", "p2"], "left_semi").select(*KEY, "t1", "t2", "gap", "p1", "off")


def _of(matches: DataFrame, anchors: DataFrame, *columns: str) -> DataFrame:
    """``matches`` with the anchors that share their search; broadcast up to a checked size."""
    asked = anchors.select("t1", "t2", (F.col("o2") - F.col("o1")).alias("gap"), "o1", *columns)
    small = asked.count() <= BROADCAST_TERMS
    return matches.join(F.broadcast(asked) if small else asked, ["t1", "t2", "gap"])


def phrase_matches(split: DataFrame, matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """_d, _h, window_id, start, n: every exact occurrence of a window.

    A document's candidates meet its words in one row, so no word array is copied per candidate.
    """
    start = F.col("p1") - F.col("o1")
    asked = (_of(matches.filter("off = 0"), anchors.filter("whole"), "window_id", "words").filter(start >= 0)
             .groupBy(*KEY).agg(F.collect_list(F.struct("window_id", start.alias("start"), "words")).alias("asked")))
    # Only the documents with candidates are shuffled with their words.
    asked = checkpoint(asked)
    own = split.select(*KEY, "w").join(few(asked.select(*KEY)), KEY, "left_semi").join(asked, KEY)
    same = F.filter("asked", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    found = own.select(*KEY, F.explode(F.transform(same, lambda c: F.struct(
        c["window_id"].alias("window_id"), c["start"].alias("start"), F.size(c["words"]).alias("n")))).alias("c"))
    return found.select(*KEY, "c.*").distinct()


def proximity_matches(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """_d, _h, item_id, start: the two rarest words of a window, at most ``slop`` off their distance."""
    near = _of(pair_matches(index, anchors, slop), anchors, "item_id")
    return near.select(*KEY, "item_id", (F.col("p1") - F.col("o1")).alias("start")).distinct()


def scan(split: DataFrame, items: DataFrame, span: int = SPAN, slop: int | None = SLOP) -> DataFrame:
    """_d, _h, n_hit, n_items, items_sha256, n_near of the documents with matches.

    ``split`` are stored tokens.  Without ``slop`` proximity is not looked for: n_near is null.
    """
    owners = checkpoint(windows(items, span))
    wanted = owners.select("window_id", "words").distinct()
    anchors = checkpoint(rarest(wanted, checkpoint(_counts(split, wanted))))
    exact = anchors.filter("whole") if slop is None else anchors
    index = store(_postings(split, exact))
    matches = store(pair_matches(index, exact, slop or 0), "matches")
    found = store(phrase_matches(split, matches, exact), "phrases")
    by_doc = Window.partitionBy(*KEY).orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("n")
    # A document's own matches: at most one per start and length, however many items share them.
    hits = (found.select(*KEY, "start", "n").distinct()
            .withColumn("fresh", F.greatest(end - F.greatest("start", F.coalesce(reach, F.lit(0))), F.lit(0)))
            .groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit")))
    holders = owners.select("window_id", "item_id")
    listed = F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",")
    named = (found.select(*KEY, "window_id").distinct().join(holders, "window_id").select(*KEY, "item_id").distinct().groupBy(*KEY)
             .agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256")))
    out = hits.join(named, KEY)
    if slop is None:
        return out.withColumn("n_near", F.lit(None).cast("long"))
    # Searches of a document first, items after: a phrase that many items share is met once.
    paired = anchors.filter("paired")
    asks = (paired.select("t1", "t2", (F.col("o2") - F.col("o1")).alias("gap"), "window_id").join(holders, "window_id")
            .select("t1", "t2", "gap", "item_id").distinct())
    small = asks.count() <= BROADCAST_TERMS
    near = (matches.select(*KEY, "t1", "t2", "gap").distinct().join(F.broadcast(asks) if small else asks, ["t1", "t2", "gap"])
            .groupBy(*KEY).agg(F.count_distinct("item_id").alias("n_near")))
    return near.join(out, KEY, "full")


def report(docs: DataFrame, items: DataFrame, span: int = SPAN, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row.

    n_near counts the items with a proximity match; it does not make a document contaminated.
    """
    split = store(tokens(docs), "tokens")
    zero = F.lit(0).cast("long")
    return (split.select("doc_id", *KEY, F.col("n").alias("n_words")).join(scan(split, items, span, slop), KEY, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                    F.coalesce("n_items", zero).alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.encode(F.lit(""), "UTF-8"), 256)).alias("items_sha256"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near")))


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of ``docs`` in which no window of any item occurs."""
    own = unused(docs)
    found = scan(store(tokens(docs), "tokens"), items, span, None).select(*(F.col(k).alias(own + k) for k in KEY))
    marked = docs.select("*", *(c.alias(own + k) for c, k in zip(_key(), KEY)))
    return marked.join(found, [own + k for k in KEY], "left_anti").select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
              array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
       FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id),
tok AS MATERIALIZED (SELECT doc_id, i AS pos, w[i] AS term FROM d, unnest(range(1, len(w) + 1)) t(i)),
win AS (SELECT DISTINCT item_id, w[s : s + least(len(w), 10) - 1] AS words
        FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) WHERE len(w) > 0),
placed AS (SELECT item_id, words, o, words[o] AS term FROM win, unnest(range(1, len(words) + 1)) t(o)),
counts AS (SELECT term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM placed) GROUP BY term),
two AS (SELECT item_id, words, list({'n': n, 'o': o, 't': term} ORDER BY n, o) AS b FROM placed JOIN counts USING (term)
        GROUP BY item_id, words HAVING count(*) > 1),
asks AS (SELECT DISTINCT item_id, b[1].t AS t1, b[2].t AS t2, b[2].o - b[1].o AS gap FROM two),
searches AS (SELECT DISTINCT t1, t2, gap FROM asks),
met AS (SELECT DISTINCT x.doc_id, s.t1, s.t2, s.gap FROM searches s JOIN tok x ON x.term = s.t1
        JOIN tok y ON y.doc_id = x.doc_id AND y.term = s.t2 AND y.pos BETWEEN x.pos + s.gap - 2 AND x.pos + s.gap + 2),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM met JOIN asks USING (t1, t2, gap) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""


@query(ORACLE)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
