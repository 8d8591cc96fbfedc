"""Near-duplicate groups: one-permutation hashing, optimal densification, banded buckets, star edges.

A text's set holds its distinct word shingles.  Texts with equal sets form a class; classes
get a signature of BINS minima under one hash, empty bins borrowing from a bin that a fixed
random order per bin names (optimal densification).  Bands of ROWS bins give buckets.

Within a bucket, candidate pairs are star-shaped: a few hubs against the members of other
components.  Confirmed links merge components, after which a bucket of one component is
done; in the others, members outside the bucket's largest component become hubs in turn,
more of them each round.  A bucket ends when every such member has been a hub, so all pairs
of one bucket that end in different components have been compared.

Two bounds on the intersection, both exact, spare most comparisons in crowded buckets: a
shingle that no other crowded text has is in no intersection, and two texts compared with
the same first hub cannot share the hub's shingles that either of them lacks.  The second
counts what the hub lacks less what nobody else has, so it holds for crowded hubs only:
such a hub has nothing that is one text's own.  So a group of
near copies costs a few comparisons of full sets per member.

Two sets of the least similarity that links share no bucket with probability
(1 - least ** ROWS) ** BANDS, about 5e-11 for the settings here.

Defined results: null, empty and blank texts have the empty set and are linked with nothing;
texts with fewer words than a shingle have one shingle, the whole sequence; repeated rows
are all returned; rows without doc_id get the component of their class, or null where the
class has no doc_id, and are not kept.  Other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import merge_labels
from ..operators.ordering import few
from .common import Tables, flat_words, mix, shared_folder, slices, table
from .registry import query

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
HUBS, MORE = 64, 16         # hubs of a bucket in the second round, and their growth per round
PER_TASK = 400_000          # shingles of crowded texts that one task counts
CROWD = 64                  # classes in a bucket from which the bounds pay

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text."""
    words, counts = flat_words(texts, lower=True)
    stops = np.cumsum(counts)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        whole = mix(whole * _A + words[k:k + len(whole)] + np.uint64(k))
    out = []
    for n, stop in zip(counts.tolist(), stops.tolist()):
        if n >= size:
            out.append(np.unique(whole[stop - n:stop - size + 1]))
        elif n:
            value = np.array([n], np.uint64) * _B
            for w in words[stop - n:stop]:
                value = mix(value * _C + w)
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _donors(seed: int = 7) -> np.ndarray:
    """Per bin, the order in which it asks the others: random, fixed, itself first."""
    rng = np.random.default_rng(seed)
    order = np.array([rng.permutation(BINS) for _ in range(BINS)])
    own = np.arange(BINS)[:, None]
    return np.concatenate([own, order[order != own].reshape(BINS, BINS - 1)], axis=1)


_DONORS = _donors()
_EDGES = (np.arange(BINS + 1).astype(object) << (64 - BINS.bit_length() + 1))
_LOWER = np.array([int(x) for x in _EDGES[:-1]], np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS bucket keys per non-empty set."""
    minima = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _LOWER)
        has = np.diff(np.append(at, len(s))) > 0
        minima[i, has] = s[at[has]]
        filled[i] = has
    for low in range(0, len(sets), 512):
        part = slice(low, low + 512)
        donor = _DONORS[np.arange(BINS), filled[part][:, _DONORS].argmax(axis=2)]
        minima[part] = np.take_along_axis(minima[part], donor, axis=1)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * _A + minima[:, k::ROWS])
    return keys.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (of the set, null if empty), buckets per row; stored in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), size)
                keys = band_keys(sets)
                digest = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                    ["doc_id", "n", "digest", "buckets"])

    path = shared_folder(docs.sparkSession, "sketches")
    (docs.select("doc_id", "text")
     .mapInArrow(run, "doc_id long, n long, digest binary, buckets array<long>").write.parquet(path))
    return docs.sparkSession.read.parquet(path)


def _pairs(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b; the hub side a is joined last, so that the rows of a hub arrive together."""
    return (edges.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))


def compared(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) on their full sets: linked (100 * intersection >= percent * union), extra
    (shingles of b that a lacks), lacks (bit i of the array: b lacks the i-th shingle of a), na.

    Rows of a document without set, or with several texts, are compared one by one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(3)):
                part = batch.slice(low, high - low)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                known = list(dict.fromkeys(left + right))
                sets = dict(zip(known, shingle_sets(known, size)))
                out = [_compare(sets[x], sets[y], percent) for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([o[0] for o in out], pa.bool_()),
                     pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())),
                     pa.array([len(sets[x]) for x in left], pa.int64())],
                    ["a", "b", "linked", "extra", "lacks", "na"])

    return _pairs(edges, texts).mapInArrow(
        run, "a long, b long, linked boolean, extra long, lacks array<long>, na long")


def _compare(hub: np.ndarray, member: np.ndarray, percent: int) -> tuple[bool, int, np.ndarray]:
    at = np.minimum(np.searchsorted(member, hub), max(len(member) - 1, 0))
    has = member[at] == hub if len(member) else np.zeros(len(hub), bool)
    common = int(has.sum())
    bits = np.packbits(np.append(~has, np.zeros(-len(hub) % 64, bool)))
    return (100 * common >= percent * (len(hub) + len(member) - common), len(member) - common,
            np.frombuffer(bits.tobytes(), np.int64))


def _possible(most, n, m, percent: int):
    """Whether an intersection of at most ``most`` allows a link of sets of n and m shingles."""
    return 100 * most >= percent * (n + m - most)


def _unique_shingles(texts: DataFrame, shingles: int, size: int) -> DataFrame:
    """rep, u: shingles of each crowded text that no other crowded text has.

    Near copies share most shingles, so they are counted within large slices first, and the
    crowded texts, which are stored apart, are read in as few tasks as hold PER_TASK of their
    ``shingles`` each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 16_000_000):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), size)
                rep = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(s) for s in sets])
                shingle, at, c = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[at], pa.int64()), pa.array(shingle.view(np.int64)), pa.array(c, pa.int64())],
                    ["rep", "shingle", "c"])

    wanted = texts.filter("crowded").select("doc_id", "text")
    return (wanted.coalesce(1 + shingles // PER_TASK).mapInArrow(run, "rep long, shingle long, c long")
            .groupBy("shingle").agg(F.min("rep").alias("rep"), F.sum("c").alias("c"))
            .filter("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u")))


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with comp after merging along ``links`` between the components of before."""
    comp = nodes.select("rep", "comp")
    ends = (links.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct())
    roots = merge_labels(ends).withColumnRenamed("node", "comp")
    # comp may be hot (one component can hold most nodes): both sides are left to AQE.
    return nodes.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).select("rep", "comp")


def components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    made = sketches(docs, size)
    kept = Tables(docs.sparkSession)
    classes = (made.filter("digest is not null").groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    member = classes.filter("rep is not null").select("rep", "n", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = kept.put("member", member.join(shared, "bucket")
                      .select("bucket", "rep", "n", (F.col("m") >= CROWD).alias("crowded")))
    nodes = kept.put("nodes", member.groupBy("rep").agg(F.first("n").alias("n"), F.max("crowded").alias("crowded")))
    texts = _texts(docs, nodes, kept)
    # One row per crowded text.
    crowd = nodes.filter("crowded").select("rep", "n")
    shingles = crowd.agg(F.sum("n")).first()[0] or 0
    unique = kept.put("unique", crowd.select("rep").join(_unique_shingles(texts, shingles, size), "rep", "left")
                      .select("rep", F.coalesce("u", F.lit(0)).alias("u")))

    # In a crowded bucket only the core, n - u, can be shared; who cannot link with it leaves the bucket.
    core = F.when(F.col("crowded"), F.col("n") - F.col("u")).otherwise(F.col("n"))
    member = kept.put("member", member.join(unique, "rep", "left").withColumn("core", core)
                      .withColumn("foreign", F.col("u").isNull())
                      .filter(_possible(F.col("core"), F.col("n"), F.col("core"), percent)).drop("u"))
    # Crowded hubs first: only they bound later pairs.
    hub = F.struct("foreign", (-F.floor(1000 * F.col("core") / F.col("n"))).alias("lone"), "rep", "n", "core")
    hubs = member.groupBy("bucket").agg(F.min(hub).alias("hub"))
    most = F.least("core", "hub.core")
    first = kept.put("tested0", member.join(hubs, "bucket").filter("rep <> hub.rep")
                     .filter(_possible(most, F.col("n"), F.col("hub.n"), percent))
                     .groupBy("rep").agg(F.min("hub").alias("hub"))
                     .select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), (~F.col("hub.foreign")).alias("bounds")))
    tested = first.select("a", "b")
    seen = kept.put("seen", compared(tested, texts, size, percent))
    once = seen.groupBy(F.col("b").alias("rep")).agg(      # one row each; several where a doc_id has several texts
        F.first("a").alias("near"), F.first("na").alias("na"), F.first("extra").alias("extra"),
        F.first("lacks").alias("lacks"), F.count(F.lit(1)).alias("rows")).filter("rows = 1").drop("rows")
    once = once.join(first.filter("bounds").select(F.col("b").alias("rep")), "rep", "left_semi")
    # What the common hub tells of a text, once per text: arrays stay out of the buckets' rows.
    told = kept.put("told", once.join(unique, "rep").withColumn("spare", F.col("extra") - F.col("u")).drop("u", "extra"))
    links = kept.put("links", seen.filter("linked").select("a", "b").distinct())
    kept.drop("seen")
    nodes = kept.put("nodes", _relabel(nodes.select("rep", F.col("rep").alias("comp")), links))
    rounds, used, hubs = 0, None, HUBS
    while True:
        at = member.select("bucket", "rep", "n", "core", "crowded").join(nodes, "rep")
        sizes = at.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
        mixed = (sizes.groupBy("bucket")
                 .agg(F.max_by("comp", F.struct(F.col("m"), -F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("c"))
                 .filter("c > 1").drop("c"))
        open_ = kept.put("open", at.join(mixed, "bucket"))
        waiting = open_.filter("comp <> main").drop("main")
        if used is not None:
            waiting = waiting.join(used, ["bucket", "rep"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("rep"))
        chosen = kept.put(f"chosen{rounds}", waiting.withColumn("k", rank).filter(F.col("k") <= hubs).drop("k"))
        if chosen.isEmpty():
            break
        turn = chosen.select("bucket", "rep")
        used = turn if used is None else used.unionByName(turn)
        rounds += 1
        edges = kept.put(f"tested{rounds}", _candidates(open_, chosen, told, percent).join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(edges)
        links = kept.put("links", compared(edges, texts, size, percent).filter("linked").select("a", "b").distinct())
        nodes = kept.put("nodes", _relabel(nodes, links))
        hubs *= MORE
    kept.drop(*(n for n in kept.paths if n != "nodes"))
    # digest may be hot (a group of exact copies): the class side has one row each, AQE splits the other.
    labels = (classes.select("digest", "rep").join(nodes.select("rep", "comp"), "rep", "left")
              .select(F.col("digest").alias("_digest"), F.coalesce("comp", "rep").alias("comp")))
    return (made.join(labels, F.col("digest") == F.col("_digest"), "left")
            .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("comp")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _candidates(open_: DataFrame, chosen: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a hub and a member of another component of its bucket that the bounds allow."""
    facts = few(told)       # one row per text that was compared with a crowded hub
    x, y = (side.join(facts, "rep", "left").alias(name) for side, name in ((open_, "x"), (chosen, "y")))
    c = F.col
    by_core = _possible(F.least("x.core", "y.core"), c("x.n"), c("y.n"), percent)
    either = F.aggregate(F.zip_with("x.lacks", "y.lacks", lambda p, q: F.bit_count(p.bitwiseOR(q))), F.lit(0),
                         lambda total, k: total + k)
    by_hub = _possible(c("x.na") - either + F.least("x.spare", "y.spare"), c("x.n"), c("y.n"), percent)
    bound = c("x.crowded") & (c("x.near") == c("y.near"))
    return (x.join(y, (c("x.bucket") == c("y.bucket")) & (c("x.comp") != c("y.comp")) & by_core
                   & F.when(bound, by_hub).otherwise(F.lit(True)))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())


def _texts(docs: DataFrame, nodes: DataFrame, kept: Tables) -> DataFrame:
    """doc_id, text, crowded of the class representatives that share a bucket; the crowded ones in files of their own."""
    path = shared_folder(docs.sparkSession, "candidates")
    (docs.select("doc_id", "text").filter("text is not null")
     .join(nodes.select(F.col("rep").alias("doc_id"), "crowded"), "doc_id").write.partitionBy("crowded").parquet(path))
    kept.paths["texts"] = path
    return docs.sparkSession.read.schema("doc_id long, text string, crowded boolean").parquet(path)


def deduplicate(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of ``docs`` that stay: one document of each group."""
    gone = components(docs, size, percent).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g
      FROM w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SHINGLE, PERCENT = 3, 85


@query(ORACLE)
def op5_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)
