"""Assembly of contexts for generation: budgets, citations, history, retrieval for many questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import exprs
from millrace.operators import search
from millrace.operators.dedup import keep_best
from millrace.operators.guards import Rejected
from millrace.operators.search import K1, B
from millrace.sources.store import Store

#: Columns that hold a score, the first present one counts.
SCORES = ("_rerank_score", "_rrf_score", "_ensemble_score", "_score", "_distance")


def score_column(df: DataFrame) -> Column:
    """A row's score whatever search it came from; distances count downwards; 0 where there is none."""
    for name in SCORES:
        if name in df.columns:
            return 1 - F.col(name) if name == "_distance" else F.col(name)
    return F.lit(0.0)


def context_window(chunks: DataFrame, by: Sequence[str], budget: int, score: str, tie: str, tokens: str = "tokens", most: int = 20, text: str | None = None) -> DataFrame:
    """Per question the best chunks whose tokens together fit the budget, at most ``most``, with their ``place``.

    Given ``text``, the first chunk that doesn't fit is cut at its last sentence that does.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    placed = chunks.withColumn("place", F.row_number().over(order)).withColumn("__used", F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("__used") <= budget
    if text is None:
        return placed.where(fits & (F.col("place") <= most)).drop("__used")
    left = (budget - (F.col("__used") - F.col(tokens))) * 4
    head = F.left(F.col(text), left.cast("int"))
    cut = F.regexp_extract(head, r"^([\s\S]*[.!?。！？])", 1)
    kept = placed.where(((F.col("__used") - F.col(tokens)) < budget) & (F.col("place") <= most))
    return kept.withColumn(text, F.when(fits, F.col(text)).otherwise(cut)).where(F.col(text) != "").drop("__used")


def assemble(chunks: DataFrame, by: Sequence[str], text: str, score: str, tie: str, most: int = 20, separator: str = "\n") -> DataFrame:
    """Per question its chunks as one ``context``, each with its number in brackets."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    numbered = chunks.withColumn("__n", place).where(F.col("__n") <= most)
    lines = F.array_sort(F.collect_list(F.struct("__n", F.concat(F.lit("["), F.col("__n"), F.lit("] "), F.col(text)).alias("line"))))  # at most ``most``
    return numbered.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), separator).alias("context"))


def verify(answers: DataFrame, key: str, text: str, sources: int, parity: bool = False) -> DataFrame:
    """Per answer: ``sentences`` (of more than six characters), ``supported`` (with a reference to a source that is there;
    in parity mode with any), ``valid_refs``, ``invalid_refs``, ``faithfulness``. A null answer gives nulls."""
    parts = F.filter(exprs.sentences(F.col(text)), lambda s: F.char_length(s) > 6)
    refs = exprs.citation_refs(F.col(text))
    holds = lambda s: F.exists(exprs.citation_refs(s), lambda r: F.lit(True) if parity else (r >= 1) & (r <= sources))
    found = answers.select(key, F.size(parts).cast("bigint").alias("n"), F.size(F.filter(parts, holds)).cast("bigint").alias("supported"), F.size(F.filter(refs, lambda r: (r >= 1) & (r <= sources))).alias("valid_refs"), F.size(F.filter(refs, lambda r: (r < 1) | (r > sources))).alias("invalid_refs"))
    given = F.col("n") >= 0
    return found.select(key, F.when(given, F.col("n")).alias("sentences"), F.when(given, F.col("supported")).alias("supported"), "valid_refs", "invalid_refs", F.when(F.col("n") > 0, F.round(F.col("supported") / F.col("n"), 6)).alias("faithfulness"))


def history(turns: DataFrame, by: Sequence[str], order: Sequence[Column], budget: int, ratio: float = 0.2, most: int = 6, tokens: str = "tokens") -> DataFrame:
    """Per conversation its last turns, at most ``most``, that fit into a share of the budget counted from the last; with their ``turn``."""
    numbered = turns.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    back = Window.partitionBy(*by).orderBy(F.desc("turn"))
    kept = numbered.withColumn("__back", F.row_number().over(back)).withColumn("__used", F.sum(tokens).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where((F.col("__back") <= most) & (F.col("__used") <= int(budget * ratio))).drop("__back", "__used")


def expand(question: str, variants: Callable[[str], Sequence[str]] | None = None) -> list[str]:
    """A question and what an injected function makes of it, each once."""
    return list(dict.fromkeys([question, *(variants(question) if variants else ())]))


def batch_retrieve(questions: DataFrame, index: DataFrame, top_k: int = 3, key: str = "doc_id", question: str = "question", id: str = "item_id") -> DataFrame:
    """For each question its ``top_k`` best texts by BM25 (ties by key): one join on terms for all questions together.

    The postings of a text lie in one task, so a question's score for it is added up there, and of each task only the
    ``top_k`` best of a question are shuffled; terms that most texts have count like all others.
    """
    asked = questions.select(id, F.explode(F.array_distinct(exprs.terms(F.col(question)))).alias("term"))
    whole = index.groupBy(key).agg(F.first("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    rarity = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(rarity, "term").join(whole)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = index.join(weighed, "term").groupBy(key, id).agg(F.round(F.sum(part), 6).alias("_score"))
    best = Window.partitionBy(id).orderBy(F.desc("_score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select(id, key, "_score", "rank")


def retrieve(df: DataFrame, question: str, strategy: str = "hybrid", vector_query: Sequence[float] | None = None, top_k: int = 10, vector: str = "text_embedding", text: str = "text_content", where: str | None = None, key: str = "id") -> DataFrame:
    """Rows for a question by ``fts``, ``vector`` or ``hybrid`` search; where hybrid finds nothing, by vector alone."""
    if strategy == "fts":
        return search.text_search(df, question, top_k, text, where, key=key)
    if vector_query is None:
        raise Rejected(f"{strategy} search needs a query vector")
    if strategy == "vector":
        return search.vector_search(df, vector_query, top_k, vector=vector, where=where, key=key)
    if strategy != "hybrid":
        raise Rejected(f"unknown strategy: {strategy}")
    found = search.hybrid_search(df, question, vector_query, top_k, vector, text, where, key)
    return search.vector_search(df, vector_query, top_k, vector=vector, where=where, key=key) if found.isEmpty() else found


def merge_retrievals(found: Sequence[DataFrame], keys: Sequence[str], tie: str) -> DataFrame:
    """What several searches found, each key once with its greatest score (``score``); columns that some lack are null."""
    scored = [f.withColumn("score", score_column(f)) for f in found]
    every = scored[0]
    for f in scored[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    return keep_best(every, keys, "score", tie)


TURN, FEEDBACK = "session_id string, turn bigint, role string, content string, created_at double", "session_id string, turn bigint, rating int, comment string, created_at double"


class Sessions:
    """Conversations and feedback as two append-only tables of a store."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def _add(self, name: str, rows: Sequence[tuple], schema: str) -> DataFrame:
        df = self.store.spark.createDataFrame(list(rows), schema)
        return self.store.append(name, df) if self.store.exists(name) else self.store.create(name, df)

    def say(self, session: str, role: str, content: str, at: float) -> int:
        """Add a turn; its number."""
        turn = self.turns(session).count() + 1
        self._add("_rag_turns", [(session, turn, role, content, at)], TURN)
        return turn

    def turns(self, session: str) -> DataFrame:
        if not self.store.exists("_rag_turns"):
            return self.store.spark.createDataFrame([], TURN)
        return self.store.read("_rag_turns").where(F.col("session_id") == session).orderBy("turn")

    def rate(self, session: str, turn: int, rating: int, comment: str, at: float) -> DataFrame:
        return self._add("_rag_feedback", [(session, turn, rating, comment, at)], FEEDBACK)


def batch_answer(questions: DataFrame, index: DataFrame, texts: DataFrame, generate: Callable[[Column, Column], Column], top_k: int = 3, key: str = "doc_id", text: str = "text", question: str = "question", id: str = "item_id") -> DataFrame:
    """``id``, ``answer``: an injected column function of question and assembled context."""
    found = batch_retrieve(questions, index, top_k, key, question, id).join(texts.select(key, text), key)
    context = assemble(found, [id], text, "_score", key, top_k)
    return questions.join(context, id, "left").select(id, generate(F.col(question), F.coalesce("context", F.lit(""))).alias("answer"))
