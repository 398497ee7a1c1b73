"""Problem 9: languages of documents and of their parts, by hyperdimensional letter n-gram profiles.

Each letter has a random bipolar vector. The vector of a trigram binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a text's vector bundles (adds) those of its trigrams; a language's prototype bundles labelled
texts. A text is compared with the prototypes by cosine. As bundling is linear, the inner product of a text's vector
with a prototype is the sum of its trigrams' inner products with it, so the executors keep one row of numbers per
trigram and language instead of adding up the long vectors anew for every sentence. The norm of a bundle of n
quasi-orthogonal vectors of length d is sqrt(n * d).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentences import is_whole, spans

#: The languages of the corpus, and the notations that name them.
LANGUAGES = ("en", "zh", "de", "fr", "es", "pt")
NOTATIONS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglês"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "chinesisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
#: Notations that name no language.
NOTHING = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "nan", "mul", "mis", "zxx", "xx", "?", "??", "-", "auto", "other", "misc")

#: Letter classes, and the length of the vectors: long enough that the noise of a bundle stays below the weight of one of its trigrams.
CLASSES, DIMENSIONS = 64, 8192


def label(lang: Column) -> Column:
    """The code a label stands for; null where it names no language, and the label itself (lower case) for any other."""
    base = F.regexp_extract(F.lower(F.trim(lang)), r"^([^-_.@ (]*)", 1)
    code = F.create_map(*[F.lit(x) for c, names in NOTATIONS.items() for n in names for x in (n, c)])
    said = F.lower(F.trim(lang))
    return F.when(lang.isNull() | said.isin(*NOTHING) | (base == "") | ~said.rlike(r"\p{L}"), F.lit(None)).otherwise(F.coalesce(code[base], base))


def _letters() -> np.ndarray:
    """Class of each code point below 65536: 0 none, 1-26 a-z, 27-50 other Latin letters, 51-54 letters of other scripts."""
    found = np.zeros(65536, dtype=np.int32)
    for point in range(65536):
        low = chr(point).lower()
        if len(low) != 1 or not low.isalpha():
            continue
        at = ord(low)
        found[point] = at - 96 if 97 <= at <= 122 else 27 + at % 24 if at < 0x250 else 51 + at % 4
    return found


_classes = _letters()
#: Code and quoted terms are evidence for no language.
_quoted = re.compile(r"`[^`\n]*`|“[^”\n]{0,80}”|\"[^\"\n]{0,80}\"|«[^»\n]{0,80}»|「[^」\n]{0,80}」")


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all texts one after the other, and where each text begins; gaps of non-letters count as one space."""
    texts = [_quoted.sub(" ", t) for t in texts]
    joined = "\n\n\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    codes = _classes[np.minimum(points, 65535)]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 3)))
    grams = (codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:]
    # those without a letter in the middle say little but where words end; those with two gaps in a row nothing
    grams = np.where((codes[1:-1] == 0) | ((codes[:-2] == 0) & (codes[2:] == 0)), 0, grams)
    return grams, np.minimum(starts, max(len(grams) - 1, 0))


@dataclass
class Profiles:
    """For each trigram its inner product with each language's prototype, divided by the norms that don't depend on the text."""

    products: np.ndarray

    def cosines(self, texts: list[str]) -> np.ndarray:
        """One row a text and one column a language; zeros for texts without letters."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        grams, starts = _trigrams(texts)
        used = np.add.reduceat((grams > 0).astype(np.float32), starts)
        sums = np.stack([np.add.reduceat(self.products[:, k][grams], starts) for k in range(len(LANGUAGES))], axis=1)
        return sums / np.sqrt(np.maximum(used, 1))[:, None]


def _vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letters bound by their places: the first rotated twice, the second once, the third as it is."""
    first, second, third = grams // CLASSES**2, grams // CLASSES % CLASSES, grams % CLASSES
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def _products(own: list[np.ndarray], letters: np.ndarray) -> np.ndarray:
    """The inner product of each trigram that occurs with each language's unit prototype.

    A trigram's weight in a bundle is its share of the language over the root of its share of all languages, so that
    what all have in common weighs little; then the mean of the prototypes is taken off each.
    """
    counts = np.stack([np.bincount(g, minlength=CLASSES**3) for g in own]).astype(np.float64)
    counts[:, 0] = 0
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    seen = np.flatnonzero(counts.sum(axis=0) > 2)
    weights = (shares / np.sqrt(shares.mean(axis=0) + 1e-6))[:, seen]
    weights -= weights.mean(axis=0)
    blocks = range(0, len(seen), 2048)
    bundles = sum(weights[:, k : k + 2048] @ _vectors(seen[k : k + 2048], letters) for k in blocks)
    unit = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
    unit *= (counts.sum(axis=1, keepdims=True) > 100)  # a language without labelled texts has no prototype
    found = np.zeros((CLASSES**3, len(own)), dtype=np.float32)
    for k in blocks:
        found[seen[k : k + 2048]] = _vectors(seen[k : k + 2048], letters) @ unit.T / np.sqrt(DIMENSIONS)
    return found


def fit(documents: DataFrame, sample: int = 6000, rounds: int = 2, seed: int = 7) -> Profiles:
    """Prototypes from a bounded sample of labelled documents, about ``sample`` of them and never more than twice that.

    Labels may be wrong: after each round every sentence of the sample counts for the language it is most like, so a
    mislabelled document doesn't stay in the wrong prototype. A language without labelled documents is never found.
    """
    labelled = documents.select("doc_id", label(F.col("lang")).alias("code"), "text").where(F.col("code").isin(*LANGUAGES) & F.col("text").isNotNull())
    share = sample / max(documents.count(), sample)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * sample)
    rows = [(LANGUAGES.index(r.code), r.text[a:b]) for r in drawn.select("code", "text").toLocalIterator() for a, b in spans(r.text)]
    letters = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(CLASSES, DIMENSIONS))
    texts, codes = [t for _, t in rows], np.array([c for c, _ in rows], dtype=np.int64)
    profiles = Profiles(np.zeros((CLASSES**3, len(LANGUAGES)), dtype=np.float32))
    for turn in range(rounds + 1 if texts else 0):
        own = [_trigrams([t for t, c in zip(texts, codes, strict=True) if c == k] or [""])[0] for k in range(len(LANGUAGES))]
        profiles.products = _products(own, letters)
        if turn < rounds:
            codes = profiles.cosines(texts).argmax(axis=1)
    return profiles


SEGMENTS = "doc_id bigint, segment_no bigint, first_char bigint, last_char bigint, sentences bigint, lang_code string, confidence double"


def segments(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """Each document in segments of one language: runs of whole sentences most like that language.

    ``first_char`` and ``last_char`` count from 1. ``confidence`` is between 0 and 1, from how much nearer the segment
    is to its language than to the next. A sentence without evidence of its own (a title, few letters, or no clear winner)
    belongs to the run it stands in. Null, empty and letterless texts give one segment without a language and with
    confidence 0. ``sentences`` counts whole sentences with evidence of their own.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # a row per trigram: the same size for any corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                cut = [spans(t) for t in texts]
                cosines = shared.value.cosines([t[a:b] for t, s in zip(texts, cut, strict=True) for a, b in s])
                k = 0
                for doc, text, own in zip(part["doc_id"], texts, cut, strict=True):
                    rows += _runs(doc, text, own, cosines[k : k + len(own)])
                    k += len(own)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return documents.select("doc_id", "text").mapInPandas(run, SEGMENTS)


def _runs(doc: int, text: str, cut: list[tuple[int, int]], cosines: np.ndarray) -> list[tuple]:
    if not len(cut) or not (cosines != 0).any():
        return [(doc, 1, 1, len(text), 0, None, 0.0)]
    top = np.sort(cosines, axis=1)
    margin = top[:, -1] - top[:, -2]
    best = cosines.argmax(axis=1)
    letters = np.array([sum(map(str.isalpha, text[a:b])) for a, b in cut])
    han = best == LANGUAGES.index("zh")
    whole = np.array([is_whole(text[a:b]) for a, b in cut])
    sure = (margin > SURE) & (letters >= np.where(han, 6, 25)) & (whole | ~whole.any())
    if not sure.any():
        sure[(margin * letters).argmax()] = True
    code = np.full(len(cut), -1)
    code[sure] = best[sure]
    for k in range(1, len(code)):  # those without evidence follow the sentence before, or the first with evidence
        if code[k] < 0:
            code[k] = code[k - 1]
    code[: np.argmax(code >= 0)] = code[np.argmax(code >= 0)]
    rows, start = [], 0
    for k in range(1, len(code) + 1):
        if k == len(code) or code[k] != code[start]:
            own = slice(start, k)
            mean = (cosines[own] * letters[own, None]).sum(axis=0) / max(letters[own].sum(), 1)
            lead = mean[code[start]] - np.partition(np.delete(mean, code[start]), -1)[-1]
            rows.append((doc, len(rows) + 1, cut[start][0] + 1, cut[k - 1][1], int((sure & whole)[own].sum()), LANGUAGES[code[start]], float(1 / (1 + np.exp(-12 * max(lead, 0) / SURE / 4)))))
            start = k
    return rows


#: The least lead of the most similar language over the next for a sentence to count as evidence, in cosine.
SURE = 0.05


def languages(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``lang_code``, ``share`` of the text, ``sentences``, ``confidence``, ``is_main``: one row a language of a document."""
    chars = F.col("last_char") - F.col("first_char") + 1
    found = segments(documents, profiles).groupBy("doc_id", "lang_code").agg(F.sum(chars).alias("chars"), F.sum("sentences").alias("sentences"), F.round(F.max("confidence"), 6).alias("confidence"))
    per = found.groupBy("doc_id").agg(F.sum("chars").alias("all_chars"), F.max_by("lang_code", F.struct("chars", "lang_code")).alias("main"))
    return found.join(per, "doc_id").select("doc_id", "lang_code", F.round(F.col("chars") / F.greatest("all_chars", F.lit(1)), 6).alias("share"), "sentences", "confidence", F.col("lang_code").eqNullSafe(F.col("main")).alias("is_main"))


def relabel(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or not the whole truth: ``doc_id``, ``lang_code``.

    A row for each language with at least one whole sentence. Another notation of the right language is not wrong.
    """
    chars = F.col("last_char") - F.col("first_char") + 1
    cut = segments(documents, profiles).where("lang_code is not null")
    per = cut.groupBy("doc_id", "lang_code").agg(F.sum(chars).alias("chars"), F.sum("sentences").alias("sentences"))
    doc = per.groupBy("doc_id").agg(F.max_by("lang_code", F.struct("chars", "lang_code")).alias("main"), F.collect_set(F.when(F.col("sentences") > 0, F.col("lang_code"))).alias("codes"))
    # a document has at most as many rows here as there are languages
    said = documents.select("doc_id", label(F.col("lang")).alias("said")).distinct()
    wrong = doc.join(said, "doc_id").where("said is null or said <> main or size(codes) > 1")
    return wrong.select("doc_id", F.explode("codes").alias("lang_code")).distinct()
