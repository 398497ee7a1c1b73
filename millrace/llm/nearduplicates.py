"""Problem 6: near-duplicate texts, by vantage-point search over Hamming fingerprints.

A text's fingerprint has one bit for each of its MinHash values, so the Hamming distance of two fingerprints estimates
their texts' Jaccard similarity. A vantage-point tree over all fingerprints of a corpus prunes nothing: measured from
any vantage point, texts of one language lie closer together than the search radius. So fingerprints are sharded first,
by bands of the same MinHash values; within a shard vantage points partition by distance, triangle bounds prune, and
in a large shard, which is cut by the nearest of its vantage points, a query visits every part its radius reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.names import bands_for
from millrace.session import materialize

SHINGLE, LEAST = 5, 0.8
#: Band rows, and how many bands find a pair at the least similarity with a chance of 0.99.
ROWS = 6
BANDS = bands_for(LEAST, 0.99, ROWS)
BITS = ROWS * BANDS
#: At the least similarity a tenth of the bits differ; four standard deviations more miss one pair in thirty thousand.
RADIUS = math.floor(BITS * (1 - LEAST) / 2 + 4 * math.sqrt(BITS * (1 - LEAST) / 2 * (1 + LEAST) / 2))
#: Shards of more fingerprints than this are cut, by so many vantage points.
LARGE, VANTAGES = 4000, 64

_rng = np.random.default_rng(23)
_times = _rng.integers(1, 2**32, BITS, dtype=np.uint32) | np.uint32(1)
_plus = _rng.integers(0, 2**32, BITS, dtype=np.uint32)
_mix = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bits) of the character 5-grams of all texts, one after the other, and how many each text has."""
    counts = np.array([max(len(t) - SHINGLE + 1, 0) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < SHINGLE:
        return np.zeros(0, np.uint64), counts
    n = len(points) - SHINGLE + 1
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        grams = (grams * np.uint64(0x100000001B3) + points[k : k + n]) * _mix
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(n) - np.repeat(starts, lengths)[:n]
    return grams[within < np.repeat(counts, lengths)[:n]], counts


def _fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of at least one shingle: fingerprints as two words of 64 bits, and the keys of their bands."""
    grams, counts = shingle_hashes(texts)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    least = np.stack([np.minimum.reduceat(small * a + b, starts) for a, b in zip(_times, _plus, strict=True)], axis=1)
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64)
    low = (bits[:, :64] << np.arange(min(64, BITS), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    high = (bits[:, 64:] << np.arange(BITS - 64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    bands = np.zeros((len(texts), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        bands = (bands + least[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r + 1)) * _mix
        bands ^= bands >> np.uint64(31)
    bands = bands * np.uint64(31) + np.arange(BANDS, dtype=np.uint64)
    return low, high, bands


FINGERPRINTED = "id string, digest binary, low bigint, high bigint, bands array<bigint>"


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        for at in range(0, len(batch), 400):
            part = batch.iloc[at : at + 400]
            texts = part["text_content"].tolist()
            low, high, bands = _fingerprints(texts)
            digest = [xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.DataFrame({"id": part["id"].to_numpy(), "digest": digest, "low": low.astype(np.int64), "high": high.astype(np.int64), "bands": list(bands.astype(np.int64))})


def fingerprints(records: DataFrame) -> DataFrame:
    """A row per record whose text has a shingle: ``id``, ``digest`` (of the text), ``low``, ``high``, ``bands``."""
    usable = records.select("id", "text_content").where((F.char_length("text_content") >= SHINGLE) & F.col("id").isNotNull())
    return usable.mapInPandas(_fingerprint, FINGERPRINTED)


def _distance(low: np.ndarray, high: np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(low[a] ^ low[b]).astype(np.int16) + np.bitwise_count(high[a] ^ high[b]).astype(np.int16)


def search(low: np.ndarray, high: np.ndarray, data: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = 48, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (query, datum) within the radius, by a vantage-point tree over ``data`` that is built and searched in one walk.

    A node's vantage point divides its data at the median distance. A query goes to the near part if its distance less
    the radius is within the median, and to the far part if its distance plus the radius is beyond it. Pairs come out in
    portions of about ``most``, so that a shard of near copies needs no memory for all of its pairs.
    """
    found_q, found_d, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    stack = [(data, queries)]
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) <= leaf:
            pairs = _within(low, high, asked, own, radius)
        else:
            vantage, own = own[0], own[1:]
            near_q = _distance(low, high, asked, vantage)
            hit = asked[near_q <= radius]
            found_q.append(hit)
            found_d.append(np.full(len(hit), vantage))
            held += len(hit)
            near_d = _distance(low, high, own, vantage)
            median = int(np.median(near_d))
            inner = near_d <= median
            if inner.all() and median == 0:  # copies of one fingerprint: no distance divides them
                pairs = _within(low, high, hit, own, radius)
            else:
                if inner.all():
                    inner = near_d < median
                    median -= 1
                stack.append((own[inner], asked[near_q - radius <= median]))
                stack.append((own[~inner], asked[near_q + radius > median]))
                pairs = iter(())
        for q, d in pairs:
            found_q.append(q)
            found_d.append(d)
            held += len(q)
            if held >= most:
                yield np.concatenate(found_q), np.concatenate(found_d)
                found_q, found_d, held = [], [], 0
    if held:
        yield np.concatenate(found_q), np.concatenate(found_d)


def _within(low: np.ndarray, high: np.ndarray, asked: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius, compared in blocks."""
    for at in range(0, len(asked), 4096):
        part = asked[at : at + 4096]
        for start in range(0, len(own), 256):
            some = own[start : start + 256]
            i, j = np.nonzero(_distance(low, high, part[:, None], some[None, :]) <= radius)
            yield part[i], some[j]


def _search_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs within each shard of rows sorted by shard; rows with ``at_home`` are data, all are queries."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (batch["shard"] == batch["shard"].iloc[-1]) & (batch["part"] == batch["part"].iloc[-1]) if len(batch) else []
        rest = batch[last]
        yield from _pairs(batch[~last] if len(batch) else batch)
    if rest is not None:
        yield from _pairs(rest)


def _pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    shard, part, node = (rows[c].to_numpy() for c in ("shard", "part", "node"))
    low, high, home = rows["low"].to_numpy().view(np.uint64), rows["high"].to_numpy().view(np.uint64), rows["at_home"].to_numpy().astype(bool)
    cuts = np.concatenate(([0], np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1, [len(rows)])) if len(rows) else np.zeros(1, int)
    sizes = np.diff(cuts)
    one, two = [], []
    for gap in range(1, 9):  # small shards, all at once
        start = np.repeat(cuts[:-1][(sizes > gap) & (sizes <= 8)], (sizes - gap)[(sizes > gap) & (sizes <= 8)])
        step = np.concatenate([np.arange(s - gap) for s in sizes[(sizes > gap) & (sizes <= 8)]] or [np.zeros(0, int)])
        i = (start + step).astype(np.int64)
        j = i + gap
        ok = (home[i] | home[j]) & (_distance(low, high, i, j) <= RADIUS)
        one.append(i[ok])
        two.append(j[ok])
    def frame(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]}).drop_duplicates()

    yield frame(np.concatenate([np.zeros(0, np.int64), *one]), np.concatenate([np.zeros(0, np.int64), *two]))
    for k in np.flatnonzero(sizes > 8):
        own = np.arange(cuts[k], cuts[k + 1])
        for q, d in search(low, high, own[home[own]], own):
            yield frame(q, d)


def _spread(shards: DataFrame) -> DataFrame:
    """Cut shards of more than ``LARGE`` rows: each row is at home in the part of its nearest vantage point, and a query
    in each other part that the triangle bound can't exclude, those with a vantage point nearer than twice the radius more."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > LARGE)
    # at most VANTAGES rows of a shard, one for each value of a hash
    drawn = shards.join(sizes.select("shard"), "shard", "left_semi").groupBy("shard", F.pmod(F.xxhash64("node"), F.lit(VANTAGES)).alias("slot")).agg(F.min(F.struct("node", "low", "high")).alias("v"))
    points = drawn.groupBy("shard").agg(F.sort_array(F.collect_list("v")).alias("points"))
    joined = shards.join(points, "shard", "left")
    far = F.transform("points", lambda v: (F.bit_count(F.col("low").bitwiseXOR(v["low"])) + F.bit_count(F.col("high").bitwiseXOR(v["high"]))))
    joined = joined.withColumn("far", far).withColumn("nearest", F.array_min("far"))
    home = F.array_position("far", F.col("nearest")).cast("int") - 1
    parts = F.filter(F.transform("far", lambda d, i: F.when(d - F.col("nearest") <= 2 * RADIUS, i)), lambda i: i.isNotNull())
    cut = joined.select("shard", "node", "low", "high", home.alias("home"), F.explode_outer(parts).alias("part"))
    return cut.select("shard", F.coalesce("part", F.lit(0)).alias("part"), "node", "low", "high", (F.col("home").isNull() | (F.col("home") == F.col("part"))).alias("at_home"))


def _jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = pd.unique(pd.concat([batch["text_a"], batch["text_b"]], ignore_index=True)).tolist()
        grams, counts = shingle_hashes(texts)
        ends = np.cumsum(counts)
        sets = {t: np.unique(grams[e - c : e]) for t, e, c in zip(texts, ends, counts, strict=True)}
        score = []
        for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
            p, q = sets[x], sets[y]
            if min(len(p), len(q)) < LEAST * max(len(p), len(q)):
                score.append(0.0)
                continue
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            score.append(shared / (len(p) + len(q) - shared))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "jaccard": score})


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and who has them. texts: ``node`` (a number of the text), ``rep`` (least id with it), fingerprint; members: ``id``, ``node``."""
    prints = materialize(fingerprints(records), "fingerprints")
    texts = prints.groupBy("digest").agg(F.min("id").alias("rep"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("bands").alias("bands"))
    texts = texts.withColumn("node", F.xxhash64("digest", F.lit(3)))
    members = prints.select("id", F.xxhash64("digest", F.lit(3)).alias("node")).distinct()
    return materialize(texts.drop("digest"), "texts"), members


def similar_texts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: ``a`` < ``b``, ``jaccard`` between different texts; members: ``id``, ``node``.

    Texts of fewer than five characters, null texts and null ids take no part; an id delivered twice counts once.
    Jaccard similarities are those of the whole texts' sets of 5-grams, computed for every pair the search finds.
    """
    texts, members = _classes(records)
    shards = texts.select(F.explode("bands").alias("shard"), "node", "low", "high")
    # both exchanges of _spread read the same narrow rows; most shards hold one text and end here
    spread = _spread(shards).repartition("shard", "part").sortWithinPartitions("shard", "part")
    pairs = spread.mapInPandas(_search_shards, "a bigint, b bigint").distinct()
    pairs = materialize(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    reps = texts.select("node", F.col("rep").alias("id")).join(wanted, "node", "left_semi")
    held = records.select("id", "text_content").join(reps, "id").groupBy("node").agg(F.first("text_content").alias("text"))
    held = materialize(held, "held")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = both.mapInPandas(_jaccard, "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= LEAST)
    return links, members


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """All pairs of ids with texts at least 0.8 similar, copies included: ``id_a`` < ``id_b``."""
    links, members = similar_texts(records)
    members = materialize(members, "members")
    one = members.select(F.col("id").alias("x"), F.col("node").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("node").alias("b"))
    across = materialize(links, "links").join(one, "a").join(two, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = one.join(two, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(copies)


def duplicate_classes(records: DataFrame) -> DataFrame:
    """A row per record: ``id``, ``class_id`` (of its exact text), ``copies`` in the class, ``links`` to other texts."""
    links, members = similar_texts(records)
    links = materialize(links, "links")
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    classes = members.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return members.join(classes, "node").join(degree, "node", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
