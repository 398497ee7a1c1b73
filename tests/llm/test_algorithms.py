"""Neighbours, near-duplicates and names against brute force on small tables."""

import math
import random

import numpy as np
import pytest

from millrace.llm import names, nearduplicates, neighbours

# --- neighbours --------------------------------------------------------------------------------------------------------------

VECTORS = "id string, text_embedding array<float>, digest string"


def table(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None, "x") for k, v in vectors], VECTORS)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 64))
    x = centers[rng.integers(6, size=900)] + 0.8 * rng.standard_normal((900, 64))
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, [(f"v{k:04}", v * (k % 7 + 0.1)) for k, v in enumerate(x)]), dimensions=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    want = {tuple(sorted((f"v{a:04}", f"v{b:04}"))) for a, row in enumerate(np.argsort(-score, axis=1)[:, :5]) for b in row}
    assert len(got & want) >= 0.9 * len(want)
    assert all(a < b for a, b in got)


def test_neighbours_of_bad_and_equal_vectors(spark):
    rng = np.random.default_rng(6)
    good = [(f"g{k}", rng.standard_normal(16)) for k in range(40)]
    same = [(f"s{k:02}", np.ones(16) * (k + 1)) for k in range(20)]
    bad = [("b1", None), ("b2", []), ("b3", np.ones(15)), ("b4", np.zeros(16)), ("b5", [math.nan] * 16), ("b6", [math.inf] + [1.0] * 15)]
    df = table(spark, good + same + bad + good[:3])
    got = neighbours.most_similar(df, 5, dimensions=16).collect()
    assert {r.id for r in got} == {k for k, _ in good + same}
    per = {}
    for r in got:
        per.setdefault(r.id, []).append(r)
    assert all(len(v) == 5 and r.id not in {x.other for x in v} for k, v in per.items() for r in v)
    assert all(x.other.startswith("s") and abs(x.cosine - 1) < 1e-2 for k, _ in same for x in per[k])


def test_neighbours_in_waves(spark, monkeypatch):
    """Only so many copies of the vectors are shuffled at a time: the same neighbours."""
    rng = np.random.default_rng(11)
    df = table(spark, [(f"v{k:03}", v) for k, v in enumerate(rng.standard_normal((150, 16)))])
    whole = {tuple(r) for r in neighbours.similar_pairs(df, dimensions=16).collect()}
    waves, write = [], neighbours.materialize_alone
    monkeypatch.setattr(neighbours, "materialize_alone", lambda df, name: waves.append(name) or write(df, name))
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    assert {tuple(r) for r in neighbours.similar_pairs(df, dimensions=16).collect()} == whole
    assert len(waves) > 2
    assert neighbours._waves({0: 3, 1: 2, 2: 9, 3: 1}, 5) == [{0, 1}, {2}, {3}]


def test_neighbours_in_blocks_and_shares(spark, monkeypatch):
    """Lists cut into blocks, their queries into shares: the same neighbours."""
    rng = np.random.default_rng(11)
    df = table(spark, [(f"v{k:03}", v) for k, v in enumerate(rng.standard_normal((150, 16)))])
    whole = {tuple(r) for r in neighbours.similar_pairs(df, dimensions=16).collect()}
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "ASKED", 20)
    assert {tuple(r) for r in neighbours.similar_pairs(df, dimensions=16).collect()} == whole


def test_neighbours_of_few(spark):
    assert neighbours.similar_pairs(table(spark, []), dimensions=8).count() == 0
    assert neighbours.similar_pairs(table(spark, [("a", np.ones(8))]), dimensions=8).count() == 0
    assert [tuple(r) for r in neighbours.similar_pairs(table(spark, [("a", np.ones(8)), ("b", np.arange(8))]), dimensions=8).collect()] == [("a", "b")]


# --- near-duplicates -----------------------------------------------------------------------------------------------------------

TEXTS = "id string, text_content string, digest string"


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(6, 80))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(1, 4)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += [texts[0]] * 3 + ["abcd", "", None, "é" * 40, "é" * 41, "好" * 6]
    rows = [(f"d{k:03}", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:2]], TEXTS)
    want = {(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if s and t and min(len(s), len(t)) >= 5 and jaccard(s, t) >= 0.8}
    got = [tuple(r) for r in nearduplicates.duplicate_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert not set(got) - want
    assert len(set(got)) >= 0.99 * len(want)
    classes = {r.id: r for r in nearduplicates.duplicate_classes(df).collect()}
    assert classes["d000"].copies == 4 and classes["d000"].class_id == "d000"
    assert "d002" in classes and all(k in classes for k, t in rows if t and len(t) >= 5)


def test_vantage_points_find_all():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    low = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(8)] + [rng.integers(0, 2**63, 400, dtype=np.uint64), base[:1].repeat(60)])
    high = np.zeros_like(low)
    every = np.arange(len(low))
    found = list(nearduplicates.search(low, high, every, every, radius=9, most=200))
    assert len(found) > 3
    got = {(a, b) for q, d in found for a, b in zip(q.tolist(), d.tolist()) if a != b}
    distance = np.bitwise_count(low[:, None] ^ low[None, :])
    want = {(a, b) for a, b in zip(*np.nonzero(distance <= 9)) if a != b}
    assert got == want


def test_large_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "LARGE", 50)
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    texts = [base[:k] + "Z" + base[k + 1 :] for k in range(0, 360, 3)]
    df = spark.createDataFrame([(f"d{k:03}", t, "x") for k, t in enumerate(texts)], TEXTS)
    assert nearduplicates.duplicate_pairs(df).count() == len(texts) * (len(texts) - 1) // 2


def test_near_duplicates_of_nothing(spark):
    assert nearduplicates.duplicate_pairs(spark.createDataFrame([], TEXTS)).count() == 0


# --- names -----------------------------------------------------------------------------------------------------------------------

VERTICES = "vertex_id bigint, name string, entity_type string, definition string, kind string"
ONE = [
    (1, "Abigail Drotichemann", "person", "project manager for the district of Bregiton"), (2, "ABIGAIL DROTICHEMANN", "Person", None), (3, "Abby Drotichemann", "PERSON", "works as project manager in Bregiton"),
    (4, "Drotichemann, A.", "person", "Bregiton-based project manager"), (5, "Abigial Drotichemann", None, "Bregiton-based project manager"), (6, "Abigail Drotichemann", "person", "translator at the Kolbuton office"),
    (10, "Bebuwit Optics Laboratory Ltd", "organization", "optics body serving Pofimouth, founded 1974"), (11, "BOL", "organization", "active in Pofimouth in the field of optics since 1974"), (12, "Bebu. Optics. Laboratory", "organization", "optics contractor from Pofimouth (since 1974)"),
    (13, "Optics Laboratory of Bebuwit", "organization", "active in Pofimouth in the field of optics since 1974"), (14, "Bebuwit Data Bureau", "organization", "data body serving Krolmaham, founded 2001"),
    (20, "cold tiers", "concept", "x"), (21, "cold tiers", None, None), (22, None, "person", None), (23, "", "person", None), (24, "!!", "person", None),
]
TWO = [(30, "Dr. Abigail Drotichemann", "person", "works as project manager in Bregiton"), (31, "云湾镇达峻宏通数据科技有限公司", "organization", "云湾镇的数据科技企业"), (32, "达峻宏通数据科技", "organization", None), (33, "cold tiers", None, None)]


def test_names(spark):
    make = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], VERTICES)
    got = {tuple(r) for r in names.linked_pairs(make(ONE + ONE[:1]), make(TWO)).collect()}
    people, labs, han = [1, 2, 3, 4, 5, 30], [10, 11, 12, 13], [31, 32]
    want = {(a, b) for own in (people, labs, han) for a in own for b in own if a < b}
    # the same name in another place may attract the one without a context, and nobody else
    assert want - got <= {(a, b) for a, b in want if 2 in (a, b)}
    assert got - want <= {(2, 6)}
    again = names.linked_pairs(make(TWO[::-1]).repartition(3), make(ONE[::-1]).repartition(5))
    assert {tuple(r) for r in again.collect()} == got


@pytest.mark.parametrize(("one", "two"), [("Loldukelk", "Lolduekck"), ("Larkamomatn", "Larkamoamnn"), ("Felirostda", "Felirontad"), ("jenny", "jennifer")])
def test_all_similar_words_that_met_are_links(spark, monkeypatch, one, two):
    """What the bands bring together is decided by word_similarity alone: a swap with another typo, and nicknames."""
    assert names.word_similarity(one.lower(), two.lower()) >= 0.8
    monkeypatch.setattr(names, "_band_keys", lambda words: words.map(lambda w: [7]))
    rows = [(k, "person", [word.lower()], False, ["bregiton"]) for k, word in ((1, one), (2, two))]
    classes = spark.createDataFrame(rows, "class_id bigint, kind string, words array<string>, acronym boolean, context array<string>")
    assert [tuple(r) for r in names._candidates(classes).collect()] == [(1, 2)]


@pytest.mark.parametrize(("one", "two"), [(["kohn", "smithers"], ["john", "smithers"]), (["smithers", "becky"], ["rebecca", "smithers"]), (["smithers"], ["lena", "smithers"])])
def test_common_words_lose_no_candidate(spark, monkeypatch, one, two):
    """A word that hundreds of names have brings those together that another word, or a place, has in common."""
    monkeypatch.setattr(names, "_band_keys", lambda words: words.map(lambda w: [hash(w) % 1000]))
    rows = [(k, "person", ["smithers", f"{chr(97 + k % 26)}{k}x{k % 7}"], False, [f"town{k}"]) for k in range(10, 300)]
    rows += [(1, "person", one, False, ["bregiton"]), (2, "person", two, False, ["bregiton"])]
    classes = spark.createDataFrame(rows, "class_id bigint, kind string, words array<string>, acronym boolean, context array<string>")
    assert (1, 2) in {tuple(r) for r in names._candidates(classes).collect()}


@pytest.mark.parametrize(("one", "two"), [(["j", "r", "smithers"], ["johannes", "ruprecht", "smithers"]), (["smithers", "lena"], ["lena", "zwicky", "qvist", "smithers"])])
def test_words_beyond_the_rarest_are_looked_up(spark, one, two):
    """All that two names share may be words that are among the rarest of neither."""
    rows = [(k, "organization", ["smithers", "lena", f"{chr(97 + k % 26)}{k}x{k % 7}"], False, [f"town{k}"]) for k in range(10, 80)]
    rows += [(1, "organization", one, False, ["bregiton"]), (2, "organization", two, False, ["bregiton"])]
    classes = spark.createDataFrame(rows, "class_id bigint, kind string, words array<string>, acronym boolean, context array<string>")
    assert names.same_name(*[{"kind": k, "words": w, "acronym": a, "context": c} for _, k, w, a, c in rows[-2:]]) > 0
    assert (1, 2) in {tuple(r) for r in names._candidates(classes).collect()}


def test_sketches_lose_no_similar_word(spark):
    """What sketches tell apart isn't similar: words with typos, short forms, initials and others, in numpy and in SQL."""
    rng = random.Random(3)
    words = ["bob", "robert", "robret", "dept", "department", "j", "jose", "abigail", "aabbaabbaa", "x" * 40, "éva"]
    for _ in range(250):
        word = "".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(2, 9)))
        k = rng.randrange(len(word))
        words += [word, word[:k] + word[k + 1 :] + word[k : k + 1], word[:k] + rng.choice("aeb") + word[k:]]
    words = sorted({w for w in words if w})
    sketched = np.array([names.sketch(w) for w in words])
    kept = names.alike(sketched[:, None], sketched[None, :])
    similar = np.array([[names.word_similarity(a, b) >= 0.8 for b in words] for a in words])
    assert not (similar & ~kept).any() and kept.mean() < 0.5
    some = rng.sample(range(len(words)), 60)
    got = spark.createDataFrame([(i, j, int(sketched[i]), int(sketched[j])) for i in some for j in some], "i int, j int, s bigint, t bigint")
    assert all(r.kept == kept[r.i, r.j] for r in got.selectExpr("i", "j", f"{names.alike_sql('s', 't')} kept").collect())


def test_names_told_apart_are_no_candidates(spark):
    """A common word brings no pairs whose other words can't be similar; joined words, places and initials stay."""
    own = [("organization", ["bebuwit", "credit", "union"], []), ("organization", ["pofimouth", "credit", "union"], []), ("organization", ["bebuwitcredit", "union"], []), ("person", ["lena", "smithers"], []), ("person", ["gus", "smithers"], ["bregiton"]), ("person", ["l", "smithers"], ["bregiton"])]
    rows = [(k, kind, words, False, context) for k, (kind, words, context) in enumerate(own)]
    classes = spark.createDataFrame(rows, "class_id bigint, kind string, words array<string>, acronym boolean, context array<string>")
    same = {(a, b) for a in range(6) for b in range(a + 1, 6) if names.same_name(*[{"kind": k, "words": w, "acronym": False, "context": c} for _, k, w, _, c in (rows[a], rows[b])]) > 0}
    got = {tuple(r) for r in names._candidates(classes).collect()}
    assert same == {(0, 2), (3, 5)} and same <= got
    assert not got & {(0, 1), (3, 4), (4, 5)}


def test_stars_of_a_long_chain(spark):
    n = 60
    vertices = spark.createDataFrame([(k, n - k) for k in range(n)], "class_id bigint, weight int")
    links = spark.createDataFrame([(k, k + 1, 0.9) for k in range(n - 1)], "a bigint, b bigint, similarity double")
    stars = {r.class_id: r.center for r in names.star_clusters(vertices, links).collect()}
    assert set(stars) == set(range(n)) and all(abs(k - c) <= 1 for k, c in stars.items())
    assert all(stars[c] == c for c in stars.values())


def test_names_of_nothing(spark):
    none = spark.createDataFrame([], VERTICES)
    assert names.linked_pairs(none, none).count() == 0


@pytest.mark.parametrize(("a", "b", "least"), [("dept", "department", 0.85), ("yusuf", "yuusf", 0.9), ("beth", "elizabeth", 0.9), ("a", "amara", 0.85)])
def test_word_similarity(a, b, least):
    assert names.word_similarity(a, b) >= least
    assert names.word_similarity(b, a) == names.word_similarity(a, b)


def test_collision_curve():
    bands = names.bands_for(0.4, 0.98, 3)
    assert 1 - (1 - 0.4**3) ** bands >= 0.98 > 1 - (1 - 0.4**3) ** (bands - 1)
