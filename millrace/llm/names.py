"""Problem 4: variant spellings of the names of persons and organisations.

MinHash banding over the padded q-grams of a name's rarest words finds similar words, and through them candidate names;
Monge-Elkan similarity with the names' context (places and years of their definitions) verifies; star clustering groups.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import materialize

#: Titles of persons, legal forms of organisations, words that carry no name.
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau".split())
FORMS = frozenset("ltd limited inc incorporated gmbh sa llc llp plc co corp corporation ag kg bv nv spa srl oy ab".split())
EMPTY = frozenset("of the and & de von van der".split())
HAN_FORMS = ("有限责任公司", "股份有限公司", "有限公司", "集团公司", "公司", "集团")
HAN = "[㐀-鿿]"
HAN_PLACE = re.compile(r"^[㐀-鿿]{2}[市县区镇乡港]")
#: Everyday short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "tony": "anthony", "bart": "bartholomew", "ben": "benjamin", "bea": "beatrice", "beth": "elizabeth",
    "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles",
    "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "rick": "richard", "rich": "richard", "ed": "edward", "eddie": "edward",
    "ted": "theodore edward", "theo": "theodore", "sandy": "alexander", "ellie": "eleanor", "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "johnny": "john",
    "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "josie": "josephine", "jo": "josephine", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "larry": "lawrence", "len": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael",
    "nate": "nathaniel", "nick": "nicholas", "pam": "pamela", "pat": "patricia", "patty": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "ron": "ronald", "sam": "samuel",
    "sue": "susan", "steve": "stephen", "stan": "stanley", "terry": "terence", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victor", "walt": "walter",
    "wally": "walter", "zach": "zachary", "zack": "zachary", "becky": "rebecca", "becca": "rebecca", "mandy": "amanda", "penny": "penelope", "trish": "patricia", "debbie": "deborah", "deb": "deborah",
}


def words_of(name: str) -> tuple[list[str], bool]:
    """A name's words, without accents, case, titles and legal forms; and whether it is an acronym.

    A name in Han characters has one word, without the legal form, the place it begins with or has in brackets.
    """
    plain = unicodedata.normalize("NFKC", name).strip()
    if re.search(r"[㐀-鿿]", plain):
        plain = re.sub(r"[(（][^)）]*[)）]", "", plain)
        for form in HAN_FORMS:
            if plain.endswith(form) and len(plain) > len(form) + 1:
                plain = plain[: -len(form)]
                break
        return [re.sub(r"\W", "", HAN_PLACE.sub("", plain) if len(plain) > 5 else plain)], False
    short = bool(re.fullmatch(r"(?:[A-Z]\.?){2,5}", plain))
    last, comma, first = plain.partition(",")
    if comma and re.sub(r"\W", "", first.lower()) not in FORMS:
        plain = f"{first.strip()} {last}"  # the family name stands first before a comma
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    plain = re.sub(r"\b([A-Za-z])\.([A-Za-z])\.", r"\1\2", plain) if short or re.search(r"\bS\.A\.", plain) else plain
    found = re.findall(r"[^\W_]+", plain.lower().replace("'", ""))
    kept = [w for w in found if w not in EMPTY]
    while kept and kept[0] in TITLES and len(kept) > 1:
        kept = kept[1:]
    if len(kept) > 2 and kept[-1] in FORMS or len(kept) > 1 and kept[-1] in FORMS - {"co"}:
        kept = kept[:-1]
    return kept, short


def context_of(name: str, definition: str | None) -> list[str]:
    """Places and years of a definition: its capitalised words, years and, in Han, what stands before 的."""
    if not isinstance(definition, str):
        return []
    if "的" in definition:
        return [definition.split("的", 1)[0][:2]]
    return sorted({m.lower() for m in re.findall(r"\b[A-Z][a-zA-Z]+", definition)} | set(re.findall(r"\b(?:1[0-9]|20)\d\d\b", definition)))


def acronym_of(words: list[str]) -> str:
    """First letters, in the order of the alphabet, as the words may have been reordered."""
    return "".join(sorted(w[0] for w in words)) if len(words) > 1 else ""


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    swapped = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    score = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return score + prefix * 0.1 * (1 - score)


def full_names(word: str) -> set[str]:
    return {word, *NICKNAMES.get(word, word).split()}


@lru_cache(maxsize=1 << 18)
def word_similarity(a: str, b: str) -> float:
    """Of two words of names: equal, initial, short form, abbreviation, or Jaro-Winkler. A task keeps what it worked out, as names share words."""
    if a == b:
        return 1.0
    short, full = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.9 if full[0] == short else 0.0
    if full_names(a) & full_names(b):
        return 0.95
    if len(short) >= 2 and len(full) - len(short) >= 2 and short[0] == full[0]:
        if full.startswith(short):
            return 0.92
        rest = iter(full)
        if len(short) <= 4 and short[-1] == full[-1] and all(c in rest for c in short):
            return 0.88
    if max(len(a), len(b)) <= 3 or (len(full) - len(short) > 3 and not {a, b} & NICKNAMES.keys()):
        return 0.0
    nick = max((jaro_winkler(n, y) for x, y in ((a, b), (b, a)) if x in NICKNAMES for n in full_names(x)), default=0.0)
    return max(jaro_winkler(a, b), nick - 0.05)


def monge_elkan(a: list[str], b: list[str]) -> tuple[float, float, int]:
    """Mean and least of the best similarities of the shorter name's words (each word used once), and how many words are left over."""
    if len(a) > len(b):
        a, b = b, a
    pairs = sorted(((word_similarity(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, scores = set(), set(), []
    for score, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            scores.append(score)
    return sum(scores) / len(scores), min(scores), len(b) - len(a)


def _joined(a: list[str], b: list[str]) -> float:
    """Similarity where words were joined or divided."""
    return jaro_winkler("".join(a), "".join(b)) if len(a) != len(b) else 0.0


def same_name(a: dict, b: dict) -> float:
    """The similarity of two names in their contexts; 0 where they don't stand for the same entity."""
    if a["kind"] and b["kind"] and a["kind"] != b["kind"]:
        return 0.0
    kind = a["kind"] or b["kind"]
    here, there = set(a["context"]), set(b["context"])
    agree = bool(here and there)
    if agree:
        places, others = {x for x in here if not x.isdigit()}, {x for x in there if not x.isdigit()}
        if not places & others or ({x for x in here if x.isdigit()} ^ {x for x in there if x.isdigit()} and len(here) == len(there) > 1):
            return 0.0
    x, y = list(a["words"]), list(b["words"])
    if not x or not y:
        return 0.0
    if re.search(r"[㐀-鿿]", x[0]) or re.search(r"[㐀-鿿]", y[0]):
        return _same_han(x[0], y[0], agree)
    for p, q in ((a, b), (b, a)):
        if p["acronym"]:
            if q["acronym"]:
                return 0.97 * (agree and p["words"] == q["words"])
            return 0.9 * (agree and len(q["words"]) > 1 and "".join(sorted("".join(p["words"]))) == acronym_of(list(q["words"])))
    score, least, extra = monge_elkan(x, y)
    long_equal = any(len(p) >= 4 and word_similarity(p, q) >= 0.86 for p in x for q in y if len(q) >= 3)
    initials = any(len(w) == 1 for w in x + y)
    if kind == "organization":
        short, full = sorted((x[0], y[0]), key=len)
        if not agree and short != full and len(short) <= 5 and full.startswith(short):
            return 0.0  # the beginning of a name is shared by many
        ok = least >= 0.8 and score >= 0.87 and long_equal and (agree or extra == 0 or min(len(x), len(y)) >= 2 and extra <= 1)
        if not ok and _joined(x, y) >= 0.96:
            return 0.95
        return (score - 0.02 * extra) * ok
    # of a person the last and the first name must agree, and at most one more may stand between them
    if min(len(x), len(y)) < 2:
        return 0.0 if not agree else (score - 0.05) * (score >= 0.9 and long_equal and extra <= 1)
    meets = lambda w, other: len(w) <= 3 or max((word_similarity(w, v) for v in other if len(v) > 1), default=0.0) >= 0.86
    # an initial stands for a given name: the last word of either name must meet a whole word
    ok = least >= 0.82 and score >= 0.87 and long_equal and extra <= 1 and meets(x[-1], y) and meets(y[-1], x)
    if ok and not agree and initials and (extra or min(len(w) for w in x) == 1 or min(len(w) for w in y) == 1):
        shorter, longer = (x, y) if sum(map(len, x)) < sum(map(len, y)) else (y, x)
        if sum(len(w) > 1 for w in shorter) < 2:
            # an initial without a context is weak, and nothing where the family name is what was cut
            family = max((word_similarity(shorter[-1], w) for w in longer if len(w) > 3), default=0.0)
            return 0.8 * (score >= 0.9 and len(shorter[-1]) > 3 and family >= 0.86)
    return (score - 0.01 * extra) * ok


def _same_han(x: str, y: str, agree: bool) -> float:
    short, full = sorted((x, y), key=len)
    if not short:
        return 0.0
    if x == y:
        return 1.0
    best = 0  # the longest stretch they share
    for i in range(len(short)):
        while i + best < len(short) and short[i : i + best + 1] in full:
            best += 1
    rest = iter(full)
    part = sum(1 for c in short if c in rest)  # how much of the shorter one is in the longer one in order
    if best >= 4 and (best >= 0.6 * len(short) or part >= 0.85 * len(short)):
        return 0.9 + 0.1 * best / len(full)
    same = sum(p == q for p, q in zip(x, y, strict=False))
    return 0.88 * (agree and len(x) == len(y) and len(x) >= 3 and same >= len(x) - 1)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """How many bands of ``rows`` hashes find pairs of that similarity with that probability: the collision curve 1-(1-s^r)^b, solved for b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


#: Similar words share at least this part of their q-grams; a swapped pair of letters in a word of eight leaves 0.4.
SIMILARITY, RECALL, ROWS, Q = 0.38, 0.98, 3, 3


def _band_keys(words: pd.Series) -> pd.Series:
    bands = bands_for(SIMILARITY, RECALL, ROWS)
    rng = np.random.default_rng(17)
    times = rng.integers(1, 2**61, bands * ROWS, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**62, bands * ROWS, dtype=np.uint64)
    found = []
    for word in words:
        padded = "#" * (Q - 1) + word + "#" * (Q - 1)
        grams = np.array([hash_gram(padded[i : i + Q]) for i in range(len(padded) - Q + 1)], dtype=np.uint64)
        mins = ((grams[:, None] * times + plus) >> np.uint64(16)).min(axis=0).reshape(bands, ROWS)
        keys = (mins * np.array([1, 1_000_003, 998_244_353], dtype=np.uint64)).sum(axis=1) * np.uint64(128) + np.arange(bands, dtype=np.uint64)
        found.append(keys.astype(np.int64).tolist())
    return pd.Series(found)


def hash_gram(gram: str) -> int:
    value = 1469598103934665603
    for c in gram:
        value = (value ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return value


PREPARED = "vertex_id bigint, kind string, words array<string>, acronym boolean, context array<string>"


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for vertex, name, kind, definition in zip(batch["vertex_id"], batch["name"], batch["kind"], batch["definition"], strict=True):
            words, acronym = words_of(name)
            if words and any(words):
                rows.append((vertex, kind, words, acronym, context_of(name, definition)))
        yield pd.DataFrame(rows, columns=["vertex_id", "kind", "words", "acronym", "context"])


#: A word in a number: of 26 classes of letters two bits each, the class of its first letter, its length, and whether it may be like words of other letters.
LETTERS, FIRST, LENGTH, WILD, LONGEST = (1 << 52) - 1, 52, 57, 1 << 62, 31
#: Names of at most so many words are told apart by the sketches of their words.
TOLD = 4


def _marks(letters: str) -> int:
    """Of each class of letters, whether one occurs and whether it occurs again."""
    found = 0
    for c in letters:
        bit = 1 << ord(c) % 26 * 2
        found |= bit << 1 if found & bit else bit
    return found


@lru_cache(maxsize=1 << 18)
def sketch(word: str) -> int:
    """What :func:`alike` reads of a word."""
    if word in NICKNAMES or not 0 < len(word) <= LONGEST:
        return WILD
    return _marks(word) | ord(word[0]) % 26 << FIRST | len(word) << LENGTH


def sketches(words: list[str], acronym: bool) -> list[int]:
    """What :func:`alike_names` reads of a name: the letters of the whole and their number, and its first words."""
    whole = "".join(words)
    every = [WILD if acronym else sketch(w) for w in words[:TOLD]]
    return [_marks(whole) | min(len(whole), 2047) << FIRST, *every]


def alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """False only where the :func:`word_similarity` of words with the sketches ``s`` and ``t`` is under 0.8.

    Jaro's similarity is at most a third of m/a + m/b + 1 with m letters in common. With other first letters it must be
    0.8, with four equal letters at the beginning 2/3, so that m/a + m/b is 1; initials and short forms have that as well.
    """
    n, m = s >> LENGTH & 31, t >> LENGTH & 31
    first = (s ^ t) >> FIRST & 31 == 0
    return ((s | t) & WILD != 0) | (5 * _common(s, t, n, m) * (n + m) >= n * m * np.where(first, 5, 7))


def _common(s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """At most so many letters have two texts of ``n`` and ``m`` letters in common: those marked in both, and what neither mark says."""
    return np.bitwise_count(s & t & LETTERS).astype(np.int64) + np.minimum(n - np.bitwise_count(s & LETTERS), m - np.bitwise_count(t & LETTERS))


def _common_sql(s: str, t: str, n: str, m: str) -> str:
    return f"(bit_count({s} & {t} & {LETTERS}) + least({n} - bit_count({s} & {LETTERS}), {m} - bit_count({t} & {LETTERS})))"


def alike_sql(s: str, t: str) -> str:
    """:func:`alike` in SQL."""
    n, m = f"(shiftright({s}, {LENGTH}) & 31)", f"(shiftright({t}, {LENGTH}) & 31)"
    return f"(({s} | {t}) & {WILD} <> 0 or 5 * {_common_sql(s, t, n, m)} * ({n} + {m}) >= {n} * {m} * if(shiftright({s} ^ {t}, {FIRST}) & 31 = 0, 5, 7))"


def alike_names(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, organization: np.ndarray) -> np.ndarray:
    """False only where :func:`same_name` is 0, as a word of the first name is like none of the other one, which has as many or more.

    ``x`` and ``y`` have a column of :func:`sketches` for each name, ``n`` and ``m`` the numbers of words. Of organisations, the
    whole may be alike where words were joined: a similarity of 0.96 has m/a + m/b of 1.8.
    """
    found = np.ones(len(n), bool)
    for i in range(TOLD):
        found &= (n <= i) | np.logical_or.reduce([(m > j) & alike(x[1 + i], y[1 + j]) for j in range(TOLD)])
    p, q = x[0] >> FIRST, y[0] >> FIRST
    whole = (np.maximum(p, q) == 2047) | (5 * _common(x[0], y[0], p, q) * (p + q) >= 9 * p * q)
    return found | (m > TOLD) | organization & (n != m) & whole


def _words(classes: DataFrame) -> DataFrame:
    """Every word of two letters or more of each name that isn't in Han: ``class_id``, ``word``."""
    parts = F.filter("words", lambda w: F.char_length(w) > 1)
    return classes.where(~F.col("words")[0].rlike(HAN)).select("class_id", F.explode(F.array_distinct(parts)).alias("word"))


def _similar_words(words: DataFrame) -> DataFrame:
    """Pairs of words whose ``word_similarity`` is at least 0.8: ``one``, ``two``, both ways, and each word with itself; ``words`` has each ``word`` once.

    Bands bring together words that share q-grams, of which only those go on whose letters allow that similarity. Short forms share few with what they stand for, so they are joined by
    what makes them similar: a full name, a beginning, or both ends of a word of at most four letters.
    """
    keys = F.pandas_udf(_band_keys, "array<bigint>")
    marks = F.pandas_udf(lambda words: words.map(sketch), "bigint")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows with much to do: spread evenly, and written, as the join reads them twice
    banded = materialize(words.repartition(parts).select("word", marks("word").alias("sketch"), F.explode(keys("word")).alias("band")), "bands")
    met = banded.alias("l").join(banded.alias("r"), F.expr(f"l.band = r.band and l.word < r.word and {alike_sql('l.sketch', 'r.sketch')}")).select(F.col("l.word").alias("one"), F.col("r.word").alias("two"))
    nick = F.create_map(*[F.lit(x) for k in NICKNAMES for x in (k, " ".join(sorted(full_names(k))))])
    named = words.select("word", F.explode(F.split(F.coalesce(nick[F.col("word")], F.col("word")), " ")).alias("full"))
    long = words.where(F.char_length("word") >= 4).withColumnRenamed("word", "two")
    begins = long.select("two", F.explode(F.transform(F.sequence(F.lit(2), F.char_length("two") - 2), lambda n: F.left("two", n))).alias("one"))
    ends = F.concat(F.left("word", F.lit(1)), F.right("word", F.lit(1)))
    brief = words.where("char_length(word) <= 4").select(F.col("word").alias("one"), ends.alias("ends"), F.char_length("word").alias("n"))
    brief = brief.join(words.select(F.col("word").alias("two"), ends.alias("ends")), "ends").where(F.char_length("two") >= F.col("n") + 2).select("one", "two")
    ways = [met, named.alias("l").join(named.alias("r"), F.expr("l.full = r.full and l.word < r.word")).select(F.col("l.word").alias("one"), F.col("r.word").alias("two"))]
    ways += [begins.join(words.withColumnRenamed("word", "one"), "one", "left_semi").select("one", "two"), brief]
    every = reduce(DataFrame.unionByName, ways).select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
    # words with more than three letters more or less are similar only as a short form
    every = every.where(F.abs(F.char_length("one") - F.char_length("two")).between(0, 3) | F.startswith("two", "one") | F.startswith("one", "two") | (F.least(F.char_length("one"), F.char_length("two")) <= 4) | F.col("one").isin(*NICKNAMES) | F.col("two").isin(*NICKNAMES))
    like = F.pandas_udf(lambda a, b: pd.Series([word_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    found = materialize(every.where(like("one", "two") >= 0.8), "similar")
    return found.unionByName(found.select(F.col("two").alias("one"), F.col("one").alias("two"))).unionByName(words.select(F.col("word").alias("one"), F.col("word").alias("two")))


def _han_keys() -> Column:
    """What two names in Han share if they may be the same: four characters in a row, the whole, or a place and, of as long a name, the first or second half."""
    name = F.col("words")[0]
    n, half = F.char_length(name), F.floor(F.char_length(name) / 2).cast("int")
    runs = F.when(n >= 4, F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.substr(name, i, F.lit(4))))
    near = F.transform("places", lambda p: F.concat(F.lit("@"), p, F.lit("<"), n.cast("string"), F.left(name, half)))
    far = F.transform("places", lambda p: F.concat(F.lit("@"), p, F.lit(">"), n.cast("string"), F.right(name, n - half)))
    return F.array_distinct(F.concat(F.coalesce(runs, F.array().cast("array<string>")), F.array(F.concat(F.lit("="), name)), near, far))


def _heads() -> Column:
    """What two names of which one has no context share if they meet on another than their rarest word and stand for the same entity.

    Another word that is similar as well begins or ends alike, a nickname as what it is short for; or both names are
    single words; or, of organisations, the joined words begin and end alike.
    """
    nick = F.create_map(*[F.lit(x) for k in NICKNAMES for x in (k, "".join(sorted({n[0] for n in full_names(k)})))])
    others = F.filter("words", lambda w: w != F.col("word"))
    begins = F.filter(F.split(F.array_join(F.transform(others, lambda w: F.coalesce(nick[w], F.left(w, F.lit(1)))), ""), ""), lambda c: c != "")
    ends = F.transform(others, lambda w: F.concat(F.lit("$"), F.right(w, F.lit(1))))
    alone = F.when(F.size(others) == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    whole = F.array_join("words", "")
    glued = F.when(F.coalesce("kind", F.lit("organization")) == "organization", F.array(F.concat(F.lit("="), F.left(whole, F.lit(3)), F.right(whole, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(begins, ends, alone, glued))


def _spots(asked: bool, parts: Column | None = None) -> Column:
    """Where names meet, so that one has no context or they share a place: at that place, or the one without a context with all.

    Of those with a context, the one that asks is at "?" too, where only names without one are found, and the one that is
    found at "*", where only names without one ask. With ``parts``, these are divided by what both have of them.
    """
    places = F.transform("places", lambda p: F.concat(F.lit("@"), p))
    at = lambda *marks: F.flatten(F.array(*[F.array(F.lit(m)) if parts is None else F.transform(parts, lambda h: F.concat(F.lit(m), h)) for m in marks]))  # noqa: B023, E731
    return F.when(F.col("parts") == 0, at("*") if asked else at("?", "*")).otherwise(F.concat(places, at("?" if asked else "*")))


#: Of names that meet at a spot, the kind is the same and, where both contexts have as many parts, all years.
MAY = """a <> b and (kind_a is null or kind_b is null or kind_a = kind_b)
    and (parts_a = 0 or parts_b = 0 or parts_a <> parts_b or parts_a = 1 or years_a = years_b)"""
#: Words left over, as ``same_name`` allows them: one, or of organisations in the same place any number; a single word needs a place, or of organisations another single one.
LEFT_OVER = """case when coalesce(kind_a, kind_b) = 'organization'
    then parts_a > 0 and parts_b > 0 or n_a = n_b or least(n_a, n_b) >= 2 and abs(n_a - n_b) <= 1
    else abs(n_a - n_b) <= 1 and (least(n_a, n_b) >= 2 or parts_a > 0 and parts_b > 0) end"""


def _told(organization: pd.Series, n: pd.Series, m: pd.Series, *drawn: pd.Series) -> pd.Series:
    half = [np.stack([d.to_numpy() for d in part]) for part in (drawn[: TOLD + 1], drawn[TOLD + 1 :])]
    return pd.Series(alike_names(*half, n.to_numpy(), m.to_numpy(), organization.to_numpy()))


def _candidates(classes: DataFrame) -> DataFrame:
    """Pairs of classes that may stand for the same entity: ``a`` < ``b``.

    All words of the name with fewer words must meet words of the other, each another one. So it is enough that of the
    words of either name, all of which are indexed, the one is looked up that meets the fewest names, if the other name
    has no initials; if it has, as many words more as it has initials, which meet no word. No word of a name is left out.
    """
    words = materialize(_words(classes), "words")
    count = words.groupBy("word").agg(F.count("*").alias("df"))
    links = materialize(_similar_words(materialize(words.select("word").distinct(), "vocabulary")), "links")
    mass = links.join(count.withColumnRenamed("word", "two"), "two").groupBy(F.col("one").alias("word")).agg(F.sum("df").alias("mass"))
    order = Window.partitionBy("class_id").orderBy("mass", "word")
    ranked = words.join(mass, "word").select("class_id", "word", F.row_number().over(order).alias("rank"), F.first("word").over(order).alias("first"))
    year, one_letter = (lambda c: c.rlike("^[0-9]+$")), (lambda w: F.char_length(w) == 1)
    marks = F.pandas_udf(lambda words, acronym: pd.Series([sketches(list(w), a) for w, a in zip(words, acronym, strict=True)], dtype=object), "array<bigint>")
    marked = classes.withColumn("sketches", marks("words", "acronym"))
    dated = marked.select(
        "class_id", "kind", "words", F.filter("context", lambda c: ~year(c)).alias("places"), F.array_join(F.filter("context", year), " ").alias("years"), F.size("context").alias("parts"),
        F.size("words").alias("n"), F.size(F.filter("words", one_letter)).alias("initials"), F.col("sketches")[0].alias("whole"), F.slice("sketches", 2, TOLD).alias("sketches"),
    )
    dated = materialize(dated, "dated")
    side = lambda df, at, *more: df.select(F.col("class_id").alias(at), *more, *[F.col(c).alias(f"{c}_{at}") for c in ("kind", "parts", "years", "n", "initials", "whole", "sketches")])
    # a name asks by its first word at its spots, by others where names with initials are, and by the second one once more
    # with what they share besides, where the bands missed the first
    more = lambda spots: F.transform(spots, lambda s: F.concat(F.lit("."), s))
    none = F.array().cast("array<string>")
    headed = lambda asked: F.transform(_spots(asked, _heads()), lambda s: F.concat(F.lit("^"), s))
    rarest = F.when(F.col("rank") == 1, F.lit(WILD)).otherwise(F.pandas_udf(lambda words: words.map(sketch), "bigint")("first"))
    ask = F.when(F.col("rank") == 1, _spots(True)).otherwise(F.concat(more(_spots(True)), F.when(F.col("rank") == 2, headed(True)).otherwise(none)))
    answer = F.concat(_spots(False), F.when(F.col("initials") > 0, more(_spots(False))).otherwise(none), headed(False))
    asked = materialize(ranked.join(dated, "class_id").withColumn("rarest", rarest).withColumn("spot", F.explode(ask)), "asked")
    found = materialize(words.join(dated, "class_id").withColumn("spot", F.explode(answer)), "found")
    # which words are similar is looked up once for all names that have them at a spot
    ways = asked.select(F.col("word").alias("one"), "spot").distinct().join(links, "one").join(found.select(F.col("word").alias("two"), "spot").distinct(), ["two", "spot"])
    ways = ways.select(F.xxhash64("one", "spot").alias("here"), F.xxhash64("two", "spot").alias("there"))
    needs = F.when(F.startswith("spot", F.lit(".")), F.col("rank") - 1).otherwise(0).alias("needs")
    # before all words are compared: the first one must be like a word of the other name, or the whole names alike where words were joined
    p, q = f"shiftright(whole_a, {FIRST})", f"shiftright(whole_b, {FIRST})"
    whole = f"n_a <> n_b and coalesce(kind_a, kind_b) = 'organization' and (greatest({p}, {q}) = 2047 or 5 * {_common_sql('whole_a', 'whole_b', p, q)} * ({p} + {q}) >= 9 * {p} * {q})"
    like = f"rarest = {WILD} or n_b > {TOLD} or exists(sketches_b, s -> {alike_sql('rarest', 's')}) or {whole}"
    # small tables that make many pairs: as many tasks as there are partitions, however few bytes they read
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = side(asked, "a", F.xxhash64("word", "spot").alias("here"), needs, "rarest").join(ways, "here").repartition(parts, "there")
    met = asking.join(side(found, "b", F.xxhash64("word", "spot").alias("there")).repartition(parts, "there"), "there")
    told = F.pandas_udf(_told, "boolean")
    by_word = met.where(f"needs <= initials_b and n_a <= n_b and {MAY} and {LEFT_OVER} and ({like})")
    by_word = by_word.where(told(F.expr("coalesce(kind_a = 'organization', kind_b = 'organization', false)"), "n_a", "n_b", *[c for at in "ab" for c in (F.col(f"whole_{at}"), *[F.coalesce(F.get(f"sketches_{at}", F.lit(i)), F.lit(0)) for i in range(TOLD)])]))
    han = dated.where(F.col("words")[0].rlike(HAN)).withColumn("key", F.explode(_han_keys()))
    spot = lambda asked: F.explode(_spots(asked)).alias("spot")
    by_run = side(han, "a", "key", spot(True)).join(side(han, "b", "key", spot(False)), ["key", "spot"]).where(f"a < b and {MAY}")
    # of organisations, words that were joined or divided: the whole begins and ends alike, whatever its words
    whole = F.array_join("words", "")
    glued = dated.where("coalesce(kind, 'organization') = 'organization'").where(~F.col("words")[0].rlike(HAN)).withColumn("key", F.concat(F.left(whole, F.lit(3)), F.right(whole, F.lit(3)))).withColumn("length", F.char_length(whole))
    by_whole = side(glued, "a", "key", spot(True), F.col("length").alias("length_a")).join(side(glued, "b", "key", spot(False), F.col("length").alias("length_b")), ["key", "spot"])
    # a similarity of 0.96 leaves a fifth of the longer one's letters unmet at most
    by_whole = by_whole.where(f"a < b and n_a <> n_b and least(length_a, length_b) >= 0.8 * greatest(length_a, length_b) and (kind_a is not null or kind_b is not null) and {MAY}")
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # acronyms share no q-grams with what they stand for; they meet on the letters and a place of the context
    letters = F.when(F.col("acronym"), F.split(F.array_join("words", ""), "")).when(F.size("words") > 1, F.transform("words", lambda w: F.substr(w, F.lit(1), F.lit(1))))
    initials = F.array_join(F.array_sort(letters), "")
    short = classes.where("coalesce(kind, 'organization') = 'organization'").select("class_id", "acronym", initials.alias("initials"), F.explode("context").alias("place")).where("initials is not null")
    named, acro = short.where("not acronym"), short.where("acronym")
    by_initials = acro.alias("l").join(named.unionByName(acro).alias("r"), F.expr("l.initials = r.initials and l.place = r.place and l.class_id <> r.class_id"))
    by_initials = by_initials.select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b"))
    return reduce(DataFrame.unionByName, [pair(df) for df in (by_word, by_run, by_whole, by_initials)]).distinct()


def _edges(classes: DataFrame) -> DataFrame:
    """Verified pairs: ``a``, ``b``, ``similarity``."""
    own = lambda k: F.struct("kind", "words", "acronym", "context").alias(k)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _candidates(classes).repartition(parts).join(classes.select(F.col("class_id").alias("a"), own("x")), "a").join(classes.select(F.col("class_id").alias("b"), own("y")), "b")

    @F.pandas_udf("double")
    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        rows = lambda z: ({"kind": k, "words": w, "acronym": a, "context": c} for k, w, a, c in zip(z["kind"], z["words"], z["acronym"], z["context"], strict=True))
        return pd.Series([float(same_name(p, q)) for p, q in zip(rows(x), rows(y), strict=True)], dtype="float64")

    return pairs.select("a", "b", score("x", "y").alias("similarity")).where("similarity > 0")


#: The part of a vertex's weight that says it has a context, so that its links are those of one entity.
ANCHORED = 8
#: How similar a bare center must be to a satellite of another star to join that star.
NEAR = 0.85


def star_clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``class_id``, ``center``: each vertex with the center of its star; ``vertices`` has ``class_id`` and ``weight``.

    In each round, the vertices that outrank all their neighbours still without a star become centers, and all their
    neighbours are covered; rank is by weight, number of neighbours and a hash of the id, so that ranks don't fall along
    chains of ids. Satellites go to the most similar center. Isolated vertices are their own center. The rounds end when
    every vertex is covered, however many that takes: each covers the highest ranked vertex of every open component.
    """
    both = edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    degree = both.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "class_id")
    ranked = materialize(vertices.join(degree, "class_id").select("class_id", F.struct("weight", "degree", F.xxhash64("class_id").alias("last"), "class_id").alias("rank")), "ranked")
    left = ranked.select(F.col("class_id").alias("a"), F.col("rank").alias("rank_a"))
    right = ranked.select(F.col("class_id").alias("b"), F.col("rank").alias("rank_b"))
    links = materialize(both.join(left, "a").join(right, "b"), "links")
    open_links, open_vertices, centers = links, ranked.select("class_id"), []
    while True:
        best = open_links.groupBy(F.col("a").alias("class_id")).agg(F.max("rank_b").alias("other"))
        chosen = open_vertices.join(ranked, "class_id").join(best, "class_id", "left").where("other is null or rank > other").select("class_id")
        chosen = materialize(chosen, "centers")
        centers.append(chosen)
        covered = links.join(chosen.withColumnRenamed("class_id", "b"), "b", "left_semi").select(F.col("a").alias("class_id")).unionByName(chosen).distinct()
        covered = materialize(covered, "covered")
        open_vertices = materialize(open_vertices.join(covered, "class_id", "left_anti"), "open")
        open_links = materialize(open_links.join(open_vertices.withColumnRenamed("class_id", "a"), "a", "left_semi").join(open_vertices.withColumnRenamed("class_id", "b"), "b", "left_semi"), "open")
        if open_vertices.isEmpty():
            break
    stars = reduce(DataFrame.unionByName, centers)
    to = links.join(stars.withColumnRenamed("class_id", "b"), "b", "left_semi").join(stars.withColumnRenamed("class_id", "a"), "a", "left_anti")
    satellites = to.groupBy(F.col("a").alias("class_id")).agg(F.max_by("b", F.struct("similarity", "rank_b")).alias("center"))
    satellites = materialize(satellites, "satellites")
    # a center whose neighbours all went to other stars joins the star of the one it is most like, if that has a context:
    # one without may stand between entities of the same name
    bare = stars.join(satellites.select(F.col("center").alias("class_id")), "class_id", "left_anti")
    near = links.join(bare.withColumnRenamed("class_id", "a"), "a", "left_semi").join(satellites.withColumnRenamed("class_id", "b"), "b")
    moved = near.where(f"similarity >= {NEAR} and rank_b.weight >= {ANCHORED}").groupBy(F.col("a").alias("class_id")).agg(F.max_by("center", F.struct("similarity", "rank_b")).alias("center"))
    moved = materialize(moved, "moved")
    kept = stars.join(moved, "class_id", "left_anti").select("class_id", F.col("class_id").alias("center"))
    alone = vertices.select("class_id").join(ranked, "class_id", "left_anti").select("class_id", F.col("class_id").alias("center"))
    return satellites.unionByName(moved).unionByName(kept).unionByName(alone)


def link_names(*tables: DataFrame, kinds: tuple[str, ...] = ("person", "organization")) -> DataFrame:
    """Which vertices stand for the same person or organisation: ``vertex_id``, ``entity_id`` (a vertex of the same entity).

    The tables need ``vertex_id``, ``name``, ``entity_type`` and ``definition``. Types count whatever their case; rows
    of another type stay out, rows without a type take part if they join an entity that has one. Names that differ only
    in case, accents, punctuation, titles or legal forms, in the same context, are one class and compared once. Rows
    without a name stay out; vertices delivered twice count once.
    """
    kind = F.lower(F.trim("entity_type"))
    every = reduce(DataFrame.unionByName, [t.select("vertex_id", "name", F.when(kind != "", kind).alias("kind"), "definition") for t in tables])
    wanted = every.where((F.col("kind").isNull() | F.col("kind").isin(*kinds)) & (F.trim("name") != ""))
    prepared = wanted.mapInPandas(_prepare, PREPARED)
    key = F.xxhash64(F.coalesce("kind", F.lit("")), F.array_join(F.array_sort("words"), " "), "acronym", F.array_join("context", " "))
    prepared = materialize(prepared.withColumn("key", key), "names")
    # what a class is called is what its least vertex is called, whichever row a task reads first: words may stand in another order
    called = F.min_by(F.struct("kind", "words", "acronym", "context"), F.struct("vertex_id", "words")).alias("c")
    members = prepared.groupBy("key").agg(F.min("vertex_id").alias("class_id"), called).select("key", "class_id", "c.*")
    classes = materialize(members, "classes")
    full = F.aggregate("words", F.lit(0), lambda n, w: n + F.when(F.char_length(w) > 1, 1).otherwise(0))
    weight = F.when(F.col("acronym"), 0).otherwise(1) + F.when(F.size("context") > 0, ANCHORED).otherwise(0) + F.when(F.col("kind").isNotNull(), 1).otherwise(0) + F.when(full > 1, 2).otherwise(0)
    stars = star_clusters(classes.select("class_id", weight.cast("int").alias("weight")), materialize(_edges(classes), "edges"))
    found = prepared.select("vertex_id", "key", "kind").distinct().join(classes.select("key", "class_id"), "key").join(stars, "class_id")
    typed = found.where("kind is not null").select("center").distinct()
    return found.join(typed, "center", "left_semi").groupBy("vertex_id").agg(F.min("center").alias("entity_id"))


def linked_pairs(*tables: DataFrame) -> DataFrame:
    """All pairs of vertices of the same person or organisation: ``vertex_id_a`` < ``vertex_id_b``."""
    entities = materialize(link_names(*tables), "entities")
    one, two = entities.withColumnRenamed("vertex_id", "vertex_id_a"), entities.withColumnRenamed("vertex_id", "vertex_id_b")
    return one.join(two, "entity_id").where("vertex_id_a < vertex_id_b").select("vertex_id_a", "vertex_id_b")
