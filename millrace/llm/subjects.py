"""Problem 5: subject areas of documents, by complement naive Bayes refined with expectation-maximization.

A word's weight for a subject compares its frequency in all text with its frequency in the complement of the subject, so
words that all subjects share weigh nothing and a small subject suffers no bias from its few texts. The first weights
come from labelled documents; expectation-maximization then goes over the sentences of all documents. Subjects are
independent of each other: each has its own calibrated posterior, so a sentence may be about none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentences import is_whole, spans

#: Features are hashed into so many numbers: the size of the model, the same for any corpus.
BITS = 18
_token = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_quoted = re.compile(r"`[^`\n]*`")


_known: dict[str, int] = {}


def _code(word: str) -> int:
    """A word's hash and kind (0 begins with a capital, 1 doesn't, 2 Han), kept for the words a task meets again and again."""
    kind = 2 if "㐀" <= word <= "鿿" else int(word[0].islower())
    found = 1 << 40 | zlib.crc32(word.lower().encode()) << 2 | kind
    if len(_known) < 500_000:
        _known[word] = found
    return found


def _features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words and word pairs of all sentences, and for each its sentence.

    Words count in lower case. Pairs are of two words that stand in lower case side by side, or of two Han characters
    (which don't count alone); digits don't count.
    """
    get, findall = _known.get, _token.findall
    codes: list[int] = []
    counts = np.zeros(len(sentences), dtype=np.int64)
    for k, sentence in enumerate(sentences):
        words = findall(sentence)
        counts[k] = len(words)
        codes += [get(w) or _code(w) for w in words]
    owner = np.repeat(np.arange(len(sentences)), counts)
    both = np.array(codes, dtype=np.uint64)
    one, kind = (both >> np.uint64(2)) & np.uint64(0xFFFFFFFF), (both & np.uint64(3)).astype(np.int8)
    if not len(one):
        return np.zeros(0, np.int64), owner
    pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    good = (owner[:-1] == owner[1:]) & (kind[:-1] == kind[1:]) & (kind[1:] > 0)
    single = kind != 2
    numbers = np.concatenate([(one[single] * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS), pair[good] >> np.uint64(64 - BITS)])
    owners = np.concatenate([owner[single], owner[1:][good]])
    order = np.argsort(owners, kind="stable")
    return numbers[order].astype(np.int64), owners[order]


def _cut(texts: list) -> tuple[list[str], np.ndarray]:  # noqa: ANN001
    """The whole sentences of all texts (all parts of a text that has none), and for each its text."""
    found: list[str] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        if isinstance(text, str):
            text = _quoted.sub(" ", text)
            own = [text[a:b] for a, b in spans(text)]
            own = [s for s in own if is_whole(s)] or own
            found += own
            owner += [k] * len(own)
    return found, np.array(owner, dtype=np.int64)


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # evidence of each feature for each subject
    slope: np.ndarray  # calibration of each subject: posterior = logistic(slope * evidence + shift)
    shift: np.ndarray

    def evidence(self, numbers: np.ndarray, owners: np.ndarray, size: int) -> np.ndarray:
        found = np.zeros((size, len(self.subjects)), dtype=np.float32)
        if len(numbers):
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            found[owners[starts]] = np.add.reduceat(self.weights[numbers], starts, axis=0)
        # words shared by two subjects count for the one with more evidence: half of the best other is taken off
        top = np.sort(found, axis=1)[:, -2:]
        if top.shape[1] == 2:
            found = found - 0.5 * np.maximum(np.where(found == top[:, 1:], top[:, :1], top[:, 1:]), 0)
        return found

    def posteriors(self, evidence: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Each subject's posterior for each sentence, given its own evidence and what its document (``owner``) is about.

        The calibrated posteriors of the sentences by themselves make up the document's composition; that takes the place
        of the prior, under which one sentence in ten is about a subject.
        """
        logit = evidence * self.slope + self.shift
        alone = _logistic(logit)
        size = np.bincount(owner)[:, None] if len(owner) else np.zeros((0, 1))
        held = np.stack([np.bincount(owner, weights=alone[:, c]) for c in range(alone.shape[1])], axis=1)
        part = np.clip((held + 0.3) / (size + 3), 0.02, 0.9)
        return _logistic(logit + (np.log(part / (1 - part)) - np.log(0.1 / 0.9))[owner])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _weights(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Evidence from counts with a row per feature, a column per subject and a last one for text about none."""
    every = counts.sum(axis=1, keepdims=True)
    rest = every - counts
    found = np.log((every + smooth) / (every.sum() + smooth * len(counts))) - np.log((rest + smooth) / (rest.sum(axis=0) + smooth * len(counts)))
    found = found[:, :-1]
    found *= np.minimum(every / 8, 1)  # a word seen a few times proves little, in whatever company
    return found.astype(np.float32)


def _calibrate(evidence: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A logistic curve per subject over the evidence of single sentences, by Newton's method with short steps.

    Positive are sentences of documents labelled with the subject that have more evidence for it than for any other;
    negative are those of documents without the label that are about another label of their document, or about nothing.
    Labels miss side remarks and may be wrong, so sentences that contradict theirs prove nothing here.
    Both weigh as their prior, one to nine. Ridged towards a
    slope of 1 and a shift of -2.
    """
    slope, shift = np.ones(evidence.shape[1]), np.full(evidence.shape[1], -2.0)
    best = evidence.argmax(axis=1)
    known = (own[np.arange(len(own)), best] > 0) | (evidence.max(axis=1) <= 1)
    for c in range(evidence.shape[1]):
        yes, no = (own[:, c] > 0) & (best == c) & (evidence[:, c] > 1), (own[:, c] == 0) & known
        if not yes.any() or not no.any():
            continue
        use = yes | no
        x = np.stack([np.clip(evidence[use, c], -10, 10), np.ones(use.sum())], axis=1)
        y = yes[use].astype(float)
        weight = np.where(y > 0, 0.1 / yes.sum(), 0.9 / no.sum()) * min(use.sum(), 5000)
        w = np.array([1.0, -2.0])
        for _ in range(40):
            p = _logistic(x @ w)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
            w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - (w - np.array([1.0, -2.0]))), -0.5, 0.5)
        slope[c], shift[c] = max(w[0], 0.1), w[1]
    return slope, shift


def _labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts and subjects of at most about ``most`` labelled documents; annotators who disagree each count their part."""
    named = labels.where(F.lower(F.trim("subject_area")).isin(subjects)).select("doc_id", F.lower(F.trim("subject_area")).alias("s"))
    share = most / max(labels.count(), most)
    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    per = drawn.groupBy("doc_id").agg(F.collect_set("s").alias("s"))  # at most as many as there are subjects
    rows = [(r.text, r.s) for r in documents.select("doc_id", "text").join(per, "doc_id").where("text is not null").limit(2 * most).toLocalIterator()]
    truth = np.zeros((len(rows), len(subjects)))
    for k, (_, own) in enumerate(rows):
        truth[k, [subjects.index(s) for s in own]] = 1
    return [t for t, _ in rows], truth


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = 20_000, rounds: int = 1, seed: int = 5) -> Model:
    """The model from a sample of at most ``most`` labelled documents, refined over all documents in ``rounds`` rounds.

    In a round every sentence of the corpus counts for the subjects it is about under the model so far, in the measure
    of their posteriors, and for none in the measure of what is left; the weights are made anew from these counts.
    Labels of unknown subjects don't count. Without labels, or without documents, nothing is about anything.
    """
    subjects = sorted({r.s.strip().lower() for r in areas.select(F.col("subject_area").alias("s")).where("s is not null").distinct().toLocalIterator()})
    texts, truth = _labelled(documents, labels, subjects, most, seed)
    model = Model(subjects, np.zeros((1 << BITS, len(subjects)), np.float32), np.ones(len(subjects)), np.full(len(subjects), -30.0))
    if not texts:
        return model
    sentences, owner = _cut(texts)
    numbers, owners = _features(sentences)
    share = truth / np.maximum(truth.sum(axis=1, keepdims=True), 1)
    own = truth[owner]
    counts = _count(numbers, np.concatenate([share[owner], np.zeros((len(owner), 1))], axis=1)[owners])
    for turn in range(rounds + 1):
        model.weights = _weights(counts)
        evidence = model.evidence(numbers, owners, len(sentences))
        model.slope, model.shift = _calibrate(evidence, own)
        if turn < rounds:
            counts = _expected(documents, model)
    return model


def _count(numbers: np.ndarray, mass: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(numbers, weights=mass[:, c], minlength=1 << BITS) for c in range(mass.shape[1])], axis=1)


def _expected(documents: DataFrame, model: Model) -> np.ndarray:
    """Expected counts of each feature for each subject and for none, over all documents.

    Each task adds up its own documents; one row per feature and task is shuffled and one per feature comes back.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    width = len(model.subjects) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = shared.value, np.zeros((1 << BITS, width))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                sentences, owner = _cut(batch["text"].iloc[at : at + 1000].tolist())
                numbers, owners = _features(sentences)
                chance = model.posteriors(model.evidence(numbers, owners, len(sentences)), owner)
                chance = chance / np.maximum(chance.sum(axis=1, keepdims=True), 1)
                mass = np.concatenate([chance, 1 - chance.sum(axis=1, keepdims=True)], axis=1)
                total += _count(numbers, mass[owners])
        seen = np.flatnonzero(total.sum(axis=1))
        yield pd.DataFrame({"feature": seen} | {f"c{c}": total[seen, c].astype(np.float32) for c in range(width)})

    columns = [f"c{c}" for c in range(width)]
    parts = documents.select("text").mapInPandas(run, "feature bigint, " + ", ".join(f"{c} float" for c in columns))
    sums = parts.groupBy("feature").agg(*[F.sum(c).cast("float").alias(c) for c in columns]).toPandas()
    counts = np.zeros((1 << BITS, width))
    counts[sums["feature"].to_numpy()] = sums[columns].to_numpy()
    return counts


def shares(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``subject_area``, ``share`` of the sentences that are about it, ``posterior`` (mean over them).

    Null and empty texts give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.subjects, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sentences, owner = _cut(part["text"].tolist())
                numbers, owners = _features(sentences)
                chance = model.posteriors(model.evidence(numbers, owners, len(sentences)), owner)
                about = chance >= 0.5
                size = np.bincount(owner, minlength=len(part))
                hits = np.stack([np.bincount(owner, weights=about[:, c], minlength=len(part)) for c in range(len(names))], axis=1)
                sure = np.stack([np.bincount(owner, weights=about[:, c] * chance[:, c], minlength=len(part)) for c in range(len(names))], axis=1)
                doc, subject = np.nonzero(hits)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject_area": names[subject], "share": (hits[doc, subject] / size[doc]).round(6), "posterior": (sure[doc, subject] / hits[doc, subject]).round(6)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, subject_area string, share double, posterior double")


def assign(documents: DataFrame, model: Model, least: float = 1 / 3) -> DataFrame:
    """``doc_id``, ``subject_area`` for each subject that at least ``least`` of the document's sentences are about."""
    return shares(documents, model).where(F.col("share") >= least - 1e-6).select("doc_id", "subject_area").distinct()
