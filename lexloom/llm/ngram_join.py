"""Operator 3: n-gram Jaccard join by vertical partitioning.

The global order of n-grams puts rare ones first and ties by hash. Two sets can only reach
the threshold if the rarest few of each share an n-gram, so those prefixes give candidate
pairs. For the candidates the global order is cut into fragments: each fragment counts the
partial overlaps of its own segments of both sets, and the counts are summed per pair, which
gives the exact overlap. (Fragments of single n-grams of the prefix give the candidates because whole
fragments of all sets would have to be shuffled to count overlaps of pairs that no bound admits.)

Groups of copies are never expanded into all pairs. Equal sets form one class, of which one
goes on. Documents of crowded buckets (more than ``CROWD`` share a prefix n-gram) meet by fine fragments of the
order instead: cut into more fragments than two linked sets have different n-grams, some fragment of
both is equal, and few other sets share it. Every other document of a bucket (documents that share a prefix n-gram or a fragment) is first compared with
the smallest id that leads one of its buckets and passes the bounds below; then only documents that
are in different components and in neighbouring bands of size meet, as pairs of ids, each once.
The bounds compare sizes and parity bits of the sets, of which there are as many as n-grams in
long sets. Both are exact, so no link between different components is lost, and few sets
besides linked ones are ever read.

The order is a matter of speed alone: the ``HOT`` most frequent n-grams, from counts of all
documents, are broadcast (a bounded table); others count as rare. N-grams are 64-bit hashes;
two n-grams of one pair of documents collide with a chance of about 1e-13.

Documents without words (null or empty text) have an empty set and no links; with fewer words
than n the whole sequence is one n-gram. Rows that repeat an id are one document: it links by its
smallest text, and each of the rows shows its own size and the document's component. Rows with a null
id link with nothing and have a null component. An empty table gives an empty result. Other columns
are not read. Very long texts are handled alone; a document's partners in lists of ``PARTNERS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import shingles
from lexloom.llm.common import BROADCAST_IDS, Tables, documents, forget, sized
from lexloom.llm.components import components

N, PERCENT = 4, 85
#: N-grams that may be told to be frequent, and n-grams of distinct sets of one local count.
HOT, CHUNK = 1 << 18, 2_000_000
#: Bytes of text that a worker handles at once.
STEP = 1 << 20
#: A local count below this is not sent on: the n-gram stays among the rare ones.
LEAST = 2
FRAGMENTS = 8
#: Documents of a bucket beyond which it is crowded, and the least threshold at which crowds meet by fragments.
CROWD, FINE = 32, 75
#: Partners of one document that are handled at once.
PARTNERS = 500
#: Sets of this size have parity bits beyond the 512.
WIDE = 512
SKETCH = [f"s{i}" for i in range(8)]


def _hot_counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0
        forget()

        def flush():
            nonlocal size
            if held:
                # Sorted in place: few arrays of this size are held at once.
                s = np.concatenate(held)
                held.clear()
                s.sort()
                starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                counts = np.diff(starts, append=len(s))
                keep = counts >= LEAST
                yield pa.RecordBatch.from_arrays([pa.array(s[starts[keep]]), pa.array(counts[keep])], names=["s", "n"])
            seen.clear()
            size = 0

        for batch in batches:
            for part in shingles.steps(batch, 0, most=STEP):
                values, offsets = shingles.ngram_sets(part.column(0), n)
                fresh = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    name = hashlib.md5(values[a:b].tobytes()).digest()
                    if name not in seen:
                        seen.add(name)
                        fresh.append(values[a:b])
                if fresh:
                    held.append(np.concatenate(fresh))
                    size += len(held[-1])
                if size >= CHUNK:
                    yield from flush()
        yield from flush()

    return run


def hot_ngrams(df: DataFrame, n: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT frequent n-grams, sorted, with their counts."""
    counts = df.select(text_col).mapInArrow(_hot_counts(n), "s long, n long")
    top = counts.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(HOT).toArrow()
    keys, times = (np.asarray(top.column(i).combine_chunks()) if top.num_rows else np.empty(0, np.int64) for i in range(2))
    order = np.argsort(keys)
    return keys[order], times[order]


def frequency(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, times = hot
    if not len(keys):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return np.where(keys[at] == s, times[at], 0)


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set in as many cells as the next power of two above its size."""
    cells = 1 << int(len(s)).bit_length()
    return np.packbits(np.bincount(s & (cells - 1), minlength=cells) & 1, bitorder="little").view(np.int64)


def _prefixes(n: int, percent: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in shingles.steps(batch, 1, most=STEP):
                values, offsets = shingles.ngram_sets(part.column(1), n)
                times = frequency(values, hot)
                sizes = np.diff(offsets)
                cells = np.repeat(np.arange(len(sizes)) * 512, sizes) + (values & 511)
                parity = np.packbits(np.bincount(cells, minlength=512 * len(sizes)) & 1).view(np.int64).reshape(-1, 8)
                heads, sigs = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    s, size = values[a:b], b - a - (percent * (b - a) + 99) // 100 + 1 if b > a else 0
                    # Sets are sorted, so a stable sort by frequency breaks ties by hash.
                    heads.append(s[np.argsort(times[a:b], kind="stable")[:size]] if times[a:b].any() else s[:size])
                    sigs.append(hashlib.md5(s.tobytes()).digest())
                ends = np.cumsum([0, *map(len, heads)])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *heads])))
                wide = pa.array([_parity(values[a:b]) if b - a >= WIDE else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(sigs, pa.binary()), prefix, wide, *(pa.array(parity[:, i]) for i in range(8))],
                    names=["id", "n", "sig", "prefix", "wide", *SKETCH],
                )

    return run


def _segments(n: int, hot: tuple[np.ndarray, np.ndarray], fragments: int):
    """Each set cut at the pivots of the global order: rare n-grams by hash, the last fragment the frequent ones.

    Columns id, text and the list of documents that the segments are sent to.
    """
    pivots = np.linspace(-(2.0**63), 2.0**63, fragments)[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in shingles.steps(batch, 1, 200, STEP):
                values, offsets = shingles.ngram_sets(part.column(1), n)
                of = np.where(frequency(values, hot) > 0, fragments - 1, np.searchsorted(pivots, values.astype(np.float64), "right"))
                ids = part.column(0).to_pylist()
                for k, partners in enumerate(part.column(2).to_pylist()):
                    s, cut = values[offsets[k] : offsets[k + 1]], of[offsets[k] : offsets[k + 1]]
                    order = np.argsort(cut, kind="stable")
                    frags, starts = np.unique(cut[order], return_index=True)
                    # Few copies of the segments are held at once, however many partners there are.
                    room = max(1, (1 << 19) // max(1, len(s)))
                    for at in range(0, len(partners), room):
                        to = partners[at : at + room]
                        flat = pa.array(np.tile(s[order], len(to)))
                        ends = (np.arange(len(to))[:, None] * len(s) + starts).ravel().tolist() + [len(s) * len(to)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(to, len(frags)), pa.int64()),
                                pa.array(np.full(len(to) * len(frags), ids[k]), pa.int64()),
                                pa.array(np.tile(frags, len(to)), pa.int32()),
                                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                            ],
                            names=["a", "b", "frag", "seg"],
                        )

    return run


def band_width(percent: int) -> float:
    """Logarithm of the ratio of sizes that a band spans: sizes of linked sets lie in one band or in neighbours."""
    return math.log(100 / percent) * (1 + 1e-9)


def fragment_keys(values: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): the contents of fine fragments of each set, such that linked sets share a key.

    Sets of the bands c and c + 1 are cut into the fragments of level c, more of them than two linked sets of
    those bands can have different n-grams, by ``spare``. So more than ``spare`` fragments of linked sets are
    equal. Empty fragments are left out; sets with more than ``spare`` of them also give the empty ones.
    """
    sizes = np.diff(offsets)
    unsigned = values.view(np.uint64) ^ np.uint64(1 << 63)  # in ascending order
    mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    bands = np.floor(np.log(np.maximum(sizes, 1)) / band_width(percent)).astype(np.int64)
    texts, keys = [], []
    for level in (bands, bands - 1):
        largest = np.ceil(np.exp(band_width(percent) * (level + 2)))
        apart = np.floor((100 - percent) * 2 * largest / (100 + percent)).astype(np.int64)
        spare = 2 + apart // 8
        count = apart + 1 + spare
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = ((unsigned >> np.uint64(32)) * count[of].astype(np.uint64)) >> np.uint64(32)
        fresh = np.ones(len(of), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(fresh)
        sums = np.add.reduceat(mixed, starts) if len(starts) else mixed[:0]
        own, frag = of[starts], at[starts]
        full = np.bincount(own, minlength=len(sizes))
        for i in np.flatnonzero((sizes > 0) & (count - full > spare)).tolist():
            empty = np.setdiff1d(np.arange(count[i]), frag[own == i].astype(np.int64)).astype(np.uint64)
            own, frag, sums = np.append(own, np.full(len(empty), i)), np.append(frag, empty), np.append(sums, np.zeros(len(empty), np.uint64))
        place = (level[own] + 1).astype(np.uint64) << np.uint64(32) | frag
        key = (sums ^ place * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        texts.append(own)
        keys.append(key.view(np.int64))
    return np.concatenate(texts), np.concatenate(keys)


def _fragments(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in shingles.steps(batch, 1, most=STEP):
                texts, keys = fragment_keys(*shingles.ngram_sets(part.column(1), n), percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(texts))], names=["s", "id"])

    return run


def _size_bound(x: str, y: str, percent: int) -> Column:
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds that every linked pair meets: by size, and by parity bits on the symmetric difference.

    Sets of ``WIDE`` n-grams or more have about as many further bits as n-grams; of two such lengths the
    longer is folded. Lengths further apart, which a low threshold allows, are not compared.
    """
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SKETCH), F.lit(0))
    v, w = F.col(f"{x}.wide"), F.col(f"{y}.wide")

    def folded(c: Column, other: Column) -> Column:
        half = (F.size(c) / 2).cast("int")
        halves = F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(half == F.size(other), halves).otherwise(c)

    bits = F.zip_with(folded(v, w), folded(w, v), lambda p, q: F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0)))
    far = F.when(F.greatest(F.size(v), F.size(w)) <= 2 * F.least(F.size(v), F.size(w)), F.aggregate(bits, F.lit(0), lambda t, i: t + i))
    within = lambda d: (100 + percent) * d <= (100 - percent) * (a + b)
    return _size_bound(x, y, percent) & within(apart) & F.when(v.isNull() | w.isNull(), F.lit(True)).otherwise(F.coalesce(within(far), F.lit(True)))


class JaccardJoin:
    """The join's steps over one table; ``classes`` and ``duplicates`` are its results."""

    def __init__(self, df: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.percent, self.tables = n, percent, Tables(df.sparkSession)
        self.rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.hot = hot_ngrams(self.rows, n, "text")
        schema = "id long, n long, sig binary, prefix array<long>, wide array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
        self.sets = self.tables.write(self.rows.mapInArrow(_prefixes(n, percent, self.hot), schema))
        # One row an id links; of rows that repeat an id it is that of the smallest text.
        self.texts, self.linking = self.rows.where("id is not null"), self.sets.where("id is not null and n > 0")
        twice = self.sets.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
        if twice.limit(1).count():
            twice = self.tables.write(twice)
            once = self.tables.write(self.texts.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
            self.texts = self.texts.join(twice, "id", "left_anti").unionByName(once)
            own = once.mapInArrow(_prefixes(n, percent, self.hot), schema).where("n > 0")
            self.linking = self.linking.join(twice, "id", "left_anti").unionByName(self.tables.write(own))

    def _cut(self, asked: DataFrame) -> DataFrame:
        """(a, b, frag, seg): the segments of every document ``id`` for each of the documents in ``to``."""
        texts = self.texts.join(sized(asked, BROADCAST_IDS), "id").select("id", "text", "to")
        return texts.mapInArrow(_segments(self.n, self.hot, FRAGMENTS), "a long, b long, frag int, seg array<long>")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(a, b, overlap) of each pair: partial overlaps by fragment, summed.

        Each segment of b is sent straight to its partner a, where a's own waits, so segments are
        shuffled once and never written. A document's partners come in lists of about ``PARTNERS``.
        """
        count = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("lists"))
        lists = pairs.join(count, "b").groupBy(F.col("b").alias("id"), F.pmod(F.xxhash64("a"), F.col("lists")).alias("list"))
        sent = self.tables.write(lists.agg(F.collect_list("a").alias("to")).select("id", "to"))
        own = self.tables.write(pairs.select(F.col("a").alias("id")).distinct().select("id", F.array("id").alias("to")))
        both = self._cut(sent).join(self._cut(own).select("a", "frag", F.col("seg").alias("y")), ["a", "frag"])
        partial = both.select("a", "b", F.size(F.array_intersect("seg", "y")).alias("o"))
        return partial.groupBy("a", "b").agg(F.sum("o").alias("overlap"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) whose similarity reaches the threshold."""
        whole = pairs.join(self.overlaps(pairs), ["a", "b"])
        return self.tables.write(
            whole.where(100 * F.col("overlap") >= self.percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")
        )

    def _near(self, pairs: DataFrame, stats: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) that meet the bounds."""
        y, x = stats.alias("y"), stats.alias("x")
        return (
            pairs.join(y, F.col("b") == F.col("y.id"))
            .join(x, (F.col("a") == F.col("x.id")) & _may_link("x", "y", self.percent))
            .select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        )

    def _meet(self, rows: DataFrame, bounds: Column, dealt: bool) -> DataFrame:
        """(a, b, na, nb) of the rows' documents of one bucket, in different components and in one band or neighbours.

        Buckets are ``dealt`` by band, or else, as few documents share each, read whole: both sides then have one shuffle.
        """
        if dealt:
            x, y = rows.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("x"), rows.alias("y")
            near = (F.col("x.at") == F.col("y.band")) & ((F.col("x.band") < F.col("y.band")) | (F.col("x.id") < F.col("y.id")))
        else:
            x, y = rows.alias("x"), rows.alias("y")
            near = (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & (F.col("x.id") < F.col("y.id"))
        met = x.join(y, (F.col("x.s") == F.col("y.s")) & near & (F.col("x.c") != F.col("y.c")) & bounds)
        low, high = (f(F.struct("x.id", "x.n"), F.struct("y.id", "y.n")) for f in (F.least, F.greatest))
        return met.select(low.alias("a"), high.alias("b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))

    def edges(self) -> DataFrame:
        """(a, b) links that connect exactly the documents that links connect."""
        sets, write, drop = self.linking, self.tables.write, self.tables.drop
        firsts = sets.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("sig", "a")
        firsts = write(firsts)
        copies = write(sets.select("sig", F.col("id").alias("b")).join(sized(firsts, BROADCAST_IDS), "sig").where("a < b").select("a", "b"))
        single = sets.join(sized(copies.select(F.col("b").alias("id")), BROADCAST_IDS), "id", "left_anti")
        # Dealt by n-gram once, at every size: the buckets' sums and the join with them read the same shuffle.
        posted = single.select("id", F.explode("prefix").alias("s")).repartition("s")
        extremes = (F.min("id").alias("hub"), F.max("id").alias("last"))
        hubs = posted.groupBy("s").agg(*extremes, F.count("*").alias("c")).where("hub < last").select("s", "hub", "c")
        buckets = write(posted.join(hubs.hint("shuffle_merge"), "s"))
        if FINE <= self.percent < 100:
            # Documents of crowded buckets meet by the contents of fine fragments instead.
            crowd = write(buckets.where(F.col("c") > CROWD).select("id").distinct())
            texts = self.texts.join(sized(crowd, BROADCAST_IDS), "id", "left_semi")
            keyed = texts.mapInArrow(_fragments(self.n, self.percent), "s long, id long")
            led = write(keyed.groupBy("s").agg(*extremes).where("hub < last").select("s", "hub"))
            fine = keyed.join(sized(led, BROADCAST_IDS), "s").select("s", "id", "hub", F.lit(True).alias("fine"))
            shared = write(buckets.where(F.col("c") <= CROWD).select("s", "id", "hub", F.lit(False).alias("fine")).union(fine))
            drop(crowd, led, buckets)
        else:
            shared = buckets = write(buckets.select("s", "id", "hub", F.lit(True).alias("fine")))
        stats = sets.select("id", "n", "wide", *SKETCH)
        first = shared.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        near = self._near(first, stats)
        # One lead for each document now; its other leads meet it below if they are still apart.
        near = write(near.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("x")).select("x.a", "b", "x.na", "x.nb"))
        links = self.linked(near)
        label = write(components(links, "a", "b"))
        at = write(shared.join(label, "id", "left").select("s", "id", "fine", F.coalesce("component", "id").alias("c")))
        mixed = write(at.groupBy("s", "fine").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s", "fine"))
        # Sizes of linked sets differ by less than two bands, so a bucket splits by band.
        band = F.floor(F.log(F.col("n")) / band_width(self.percent)).cast("int") if self.percent < 100 else F.col("n").cast("int")
        stats = stats.withColumn("band", band)
        left = at.join(sized(mixed, BROADCAST_IDS), ["s", "fine"], "left_semi")
        small = write(left.where("not fine").drop("fine").join(stats.select("id", "n", "band"), "id"))
        large = write(left.where("fine").drop("fine").join(stats, "id"))
        # Buckets of few documents: pairs of ids, each once, and then the bounds.
        meet = self._meet(small, _size_bound("x", "y", self.percent), False).select("a", "b").distinct()
        few = self._near(meet, stats.drop("band"))
        # Others: only what meets the bounds leaves the join.
        many = self._meet(large, _may_link("x", "y", self.percent), True).distinct()
        rest = write(few.union(many).distinct())
        drop(shared, at, mixed, small, large)
        more = self.linked(rest)
        drop(near, rest, label)
        return links.union(more).union(copies)

    def duplicates(self) -> DataFrame:
        """(id) of the documents that are not the first of their component."""
        label = components(self.edges(), "a", "b")
        return self.tables.write(label.where("id <> component").select("id").distinct())

    def classes(self) -> DataFrame:
        """(id, n, component) of every row."""
        label = components(self.edges(), "a", "b")
        out = self.sets.select("id", "n").join(label, "id", "left")
        return out.select("id", "n", F.coalesce("component", "id").alias("component"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = JaccardJoin(documents(spark, sf_dir)).classes()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (
  SELECT a, a FROM both_ways UNION SELECT a, b FROM both_ways
  UNION
  SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
least_of AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id)::BIGINT AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON v = doc_id
"""
QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES = {"op3_ngram_join": ORACLE}
