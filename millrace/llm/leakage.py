"""Problem 7: held-out items that leaked into documents, by template windows and the consistency of their slots.

Both sides are canonicalised: numbers, units and names become typed slots, all other words stay. Documents of this
corpus share their sentence templates with the items, so a template window alone says little: windows are joined by the
hash of the template together with the value of one of its slots, once per slot. A re-parameterised sentence, with one
slot changed and the others kept, still meets; the same template with other values doesn't. Pairs with enough such
windows are then aligned word by word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, HAN_WINDOW = 6, 10
#: Units that stand after numbers.
UNITS = frozenset("percent hour hours day days week weeks gram grams kg km year years unit units stunden tage jahre heures jours ans horas días dias años anos".split())
_token = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+")
_han = re.compile(r"[㐀-鿿぀-ヿ]")
_mult = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Words in lower case, and each Han character by itself; a thousands separator doesn't split a number."""
    return _token.findall(_thousands.sub("", text).lower())


_thousands = re.compile(r"(?<=\d)[., \xa0' ](?=\d{3}(?!\d))")


def passages(items: list[tuple[int, str]]) -> dict[int, str]:
    """The passage of each item: without the instruction before its first blank line and the question in its last line.

    A head counts as an instruction where several items have it; without one the whole text is the passage.
    """
    heads = Counter(t.split("\n\n", 1)[0].strip() for _, t in items if "\n\n" in t)
    found = {}
    for item, text in items:
        body = text
        if "\n\n" in text and heads[text.split("\n\n", 1)[0].strip()] > 1:
            body = text.split("\n\n", 1)[1]
            kept, _, last = body.rstrip().rpartition("\n")
            if kept.strip() and last.rstrip().endswith("?"):
                body = kept
        if body.strip():
            found[item] = body
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _mult
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Index:
    """Of a block of items: the numbers of their words, each word's type, and the keys of their windows."""

    numbers: dict[str, int]
    kinds: np.ndarray  # 0 unknown (any name), 1 a plain word, 2 number, 3 name, 4 unit, 5 Han
    words: dict[int, np.ndarray]
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owners: list[np.ndarray] = field(default_factory=list)  # for each key the items that have it
    windows: dict[int, int] = field(default_factory=dict)  # for each item how many positions have a key

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word (0 if no item has it), and its type."""
        get = self.numbers.get
        found = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        kinds = self.kinds[found]
        if len(missing := np.flatnonzero(found == 0)):
            kinds[missing] = [2 if words[i][0].isdigit() else 5 if _han.match(words[i]) else 3 for i in missing]
        return found, kinds

    def window_keys(self, found: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and the positions of their windows: (template, place of a slot, its value), and whole windows of Han."""
        keys, places = [], []
        if len(found) >= WINDOW:
            plain = np.where((kinds == 1), found + 16, kinds).astype(np.uint64)
            n = len(found) - WINDOW + 1
            template = np.zeros(n, dtype=np.uint64)
            for j in range(WINDOW):
                template = _mix(template + plain[j : j + n] + np.uint64(j + 1))
            words = np.convolve((kinds != 5), np.ones(WINDOW), "valid") > WINDOW - 2
            for j in range(WINDOW):
                slot = kinds[j : j + n]
                at = np.flatnonzero(((slot == 2) | (slot == 3)) & (found[j : j + n] > 0) & words)
                keys.append(_mix(template[at] ^ _mix(found[j : j + n][at].astype(np.uint64) * np.uint64(64) + np.uint64(j))))
                places.append(at)
        if len(found) >= HAN_WINDOW and (kinds == 5).any():
            n = len(found) - HAN_WINDOW + 1
            exact = np.zeros(n, dtype=np.uint64)
            for j in range(HAN_WINDOW):
                exact = _mix(exact + found[j : j + n].astype(np.uint64) + np.uint64(100 + j))
            at = np.flatnonzero((np.convolve(kinds == 5, np.ones(HAN_WINDOW), "valid") >= HAN_WINDOW * 0.6) & (np.convolve(found > 0, np.ones(HAN_WINDOW), "valid") == HAN_WINDOW))
            keys.append(exact[at])
            places.append(at)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(places)


def build_index(block: dict[int, str]) -> Index:
    """The index of a block of passages. A word is a name where it stands capitalised within a sentence and never in lower case."""
    upper, lower = set(), set()
    for text in block.values():
        for m in re.finditer(r"[^\W_㐀-鿿]+", text):
            (lower if m[0][0].islower() else upper if m[0][0].isupper() and re.search(r"[\w,;]\s+$", text[max(0, m.start() - 4) : m.start()]) else set()).add(m[0].lower())
    words = {item: tokens(text) for item, text in block.items()}
    numbers = {w: k + 1 for k, w in enumerate(sorted({w for own in words.values() for w in own}))}
    kinds = np.zeros(len(numbers) + 1, dtype=np.int8)
    for w, k in numbers.items():
        kinds[k] = 2 if w[0].isdigit() else 5 if _han.match(w) else 4 if w in UNITS else 3 if w in upper and w not in lower else 1
    index = Index(numbers, kinds, {})
    owned: dict[int, set[int]] = defaultdict(set)
    for item, own in words.items():
        found, kind = index.codes(own)
        index.words[item] = found
        keys, places = index.window_keys(found, kind)
        index.windows[item] = len(np.unique(places))
        for key in keys.tolist():
            owned[key].add(item)
    order = sorted(owned)
    index.keys = np.array(order, dtype=np.uint64)
    index.owners = [np.array(sorted(owned[k]), dtype=np.int64) for k in order]
    return index


def held(item: np.ndarray, doc: np.ndarray, kinds: np.ndarray, gap: int = 60, han_gap: int = 150) -> float:
    """The share of the item's words that the document holds in the item's order, in one run or a few close to each other.

    Equal words count in runs of at least three. Runs are chained in order, with at most ``gap`` words of the document
    between two of them (``han_gap`` in texts of Han characters). A run counts only where slots agree: at least half of
    the numbers and names that the item has around it must be in runs themselves.
    """
    if (kinds[item] == 5).mean() > 0.5:
        gap = han_gap
    places: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(doc.tolist()):
        if w:
            places[w].append(k)
    runs: list[tuple[int, int, int]] = []  # (place in the item, in the document, length), maximal
    n, m = len(item), len(doc)
    ahead: dict[int, int] = {}
    for i in range(n):
        now = {}
        for k in places.get(int(item[i]), ()):
            now[k] = ahead.get(k - 1, 0) + 1
            if i + 1 == n or k + 1 == m or item[i + 1] != doc[k + 1]:
                if now[k] >= 3:
                    runs.append((i - now[k] + 1, k - now[k] + 1, now[k]))
        ahead = now
    if not runs:
        return 0.0
    slot = np.isin(kinds[item], (2, 3))
    runs.sort()
    best: list[tuple[float, int]] = []  # of each run: the best weight of a chain that ends with it, and the run before
    for r, (i, k, length) in enumerate(runs):
        weight, before = float(length), -1
        for q in range(r - 1, -1, -1):
            a, b, size = runs[q]
            cut = max(a + size - i, b + size - k, 0)
            if a < i and b < k and cut < length and k - (b + size) <= gap:
                drift = abs((k - b) - (i - a))
                w = best[q][0] + length - cut - 0.1 * min(drift, 20)
                if w > weight:
                    weight, before = w, q
        best.append((weight, before))
    chain, r = [], int(np.argmax([w for w, _ in best]))
    while r >= 0:
        chain.append(runs[r])
        r = best[r][1]
    covered = np.zeros(n, dtype=bool)
    for i, _, length in chain:
        covered[i : i + length] = True
    around = 8
    total = 0
    for i, _, length in chain:
        lo, hi = max(0, i - around), min(n, i + length + around)
        slots = slot[lo:hi]
        agree = covered[lo:hi][slots].mean() if slots.any() else 1.0
        if agree >= 0.5 or length >= 12:
            total += int(covered[i : i + length].sum())
    return min(total, n) / n


def find_leaks(documents: DataFrame, items: DataFrame, least: float = 0.5, block: int = 20_000) -> DataFrame:
    """Documents that hold at least ``least`` of an item's passage, with the item: ``doc_id``, ``item_id``, ``held``.

    ``documents`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``item_text``; other columns don't matter.
    Letter case, punctuation, spacing, line ends and list marks make no difference. Null and empty texts and items
    without a passage give no rows; a repeated pair counts once. The items, a held-out set, are indexed in blocks of at
    most ``block`` on the driver, and each block's index goes to the executors; the documents are read once per block.
    """
    drawn = items.select("item_id", "item_text").where("item_text is not null").groupBy("item_id").agg(F.max("item_text").alias("t"))
    texts = passages([(r.item_id, r.t) for r in drawn.toLocalIterator()])
    order = sorted(texts)
    spark, found = documents.sparkSession, None
    for at in range(0, max(len(order), 1), block):
        index = spark.sparkContext.broadcast(build_index({k: texts[k] for k in order[at : at + block]}))
        part = documents.select("doc_id", "text").mapInPandas(_searcher(index, least), "doc_id bigint, item_id bigint, held double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))


def _searcher(shared, least: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                own = [tokens(t) if isinstance(t, str) else [] for t in part["text"]]
                lengths = np.array([len(w) for w in own])
                found, kinds = index.codes([w for words in own for w in words])
                keys, places = index.window_keys(found, kinds)
                if not len(keys) or not len(index.keys):
                    continue
                spot = np.minimum(np.searchsorted(index.keys, keys), len(index.keys) - 1)
                hit = np.flatnonzero(index.keys[spot] == keys)
                ends = np.cumsum(lengths)
                docs = np.searchsorted(ends, places[hit], side="right")
                seen: dict[tuple[int, int], set[int]] = defaultdict(set)
                for doc, key, place in zip(docs.tolist(), spot[hit].tolist(), places[hit].tolist(), strict=True):
                    for item in index.owners[key].tolist():
                        seen[doc, item].add(place)
                ids = part["doc_id"].to_numpy()
                for (doc, item), spots in seen.items():
                    # changed words break most windows around them, and half of the passage is enough
                    if len(spots) >= max(2, 0.1 * index.windows[item]):
                        start = ends[doc] - lengths[doc]
                        share = held(index.words[item], found[start : ends[doc]], index.kinds)
                        if share >= least:
                            rows.append((ids[doc], item, float(round(share, 6))))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "held"])

    return run
