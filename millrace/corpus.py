"""The search and answer API over a corpus of sources and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import parsed
from .functions.english import query_lexemes
from .functions.headline import headline
from .functions.text import meta_line, source_id, split_source_id, strip_marks, titled
from .operators.ingest import attribute
from .options import SearchOptions, checked_query
from .plans import search as plans
from .sources.corpus import stored_postings
from .sources.vector_index import VectorIndex
from .tables import materialize

KEY = re.compile(r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]+-[0-9]+(?![A-Za-z0-9_])")


#: What a model is told before the context and the question.
RULES = """You answer questions from the numbered excerpts that you are given, and from nothing else.
If they don't hold the answer, say that you don't know. After each statement name its excerpts as [^1], [^2].
Be brief, don't repeat the question, and use simple markdown where it helps."""


class Corpus:
    """``sources`` has source_id, source_type, source_key, project, title, url, body, updated_at and, where they are kept, open attributes
    in extra, which hits and prompts show; ``chunks`` has chunk_id,
    source_id, embedding, text. ``embedder`` turns a question into a vector. ``postings`` is the place of the chunks'
    stored lexemes (``sources.corpus.write_postings``), ``index`` one of their vectors and ``probes`` how many of its lists a question reads;
    without them each question reads all texts and vectors, and without ``probes`` all lists that may have a hit."""

    def __init__(
        self, sources: DataFrame, chunks: DataFrame, embedder: Callable[[str], list[float]], postings: str | None = None,
        index: VectorIndex | None = None, probes: int | None = None,
    ):
        self.sources, self.chunks, self.embedder, self.postings, self.index, self.probes = sources, chunks, embedder, postings, index, probes

    def named(self, q: str, most: int = 5) -> DataFrame:
        """Records whose keys a question names, in its order; filters don't hold for them."""
        keys = list(dict.fromkeys(KEY.findall(q)))[:most]
        order = F.array_position(F.array(*map(F.lit, keys)).cast("array<string>"), F.col("source_key"))
        return self.sources.where((F.col("source_type") == "jira") & F.col("source_key").isin(*keys)).select("source_id", order.alias("ord"))

    def search(self, q: str, options: SearchOptions = SearchOptions(), *, as_of: Column | None = None) -> DataFrame:
        """At most ``options.limit`` hits: named records with score 1, then hybrid hits, each source once, with rank,
        title, url, snippet, score and, for named records, the body.

        Filters written in the question (``filters.parsed``) join those of the options. Newer sources are raised, as of now
        unless ``as_of`` says otherwise. Where named records fill the limit, nothing else is looked up.
        """
        q = checked_query(q)
        found = parsed(q)
        options = options.also(found.sources, found.projects + found.spaces, found.after)
        text = checked_query(found.text)
        terms = query_lexemes(text)
        named = self.named(text)
        keys = set(KEY.findall(text))
        if len(keys) >= options.limit and named.limit(options.limit).count() == options.limit:
            hits = named.orderBy("ord").limit(options.limit)
            hits = hits.select("source_id", F.lit(1.0).alias("score"), F.lit(0).alias("part"), "ord", F.lit(None).cast("string").alias("text"))
        else:
            stored = stored_postings(self.chunks.sparkSession, self.postings, terms) if self.postings and terms else None
            of = self.sources.select("source_id", "source_type", "project", "updated_at")
            question = self.embedder(text)
            near = self.index.hits(question, options.candidates, self.probes) if self.index else None
            ranked = plans.hybrid(self.chunks, of, question, terms, options, as_of=as_of, stemmed=True, stored=stored, vector=near)
            hits = plans.merged(named, ranked.select("source_id", "chunk_id", "score"), options.limit)
            hits = hits.join(self.chunks.select("chunk_id", "text"), "chunk_id", "left").select("source_id", "score", "part", "ord", "text")
        hits = hits.join(self.sources, "source_id")
        is_named = F.col("part") == 0
        rank = F.row_number().over(Window.orderBy("part", "ord", F.desc("score"), "source_id"))
        shown = F.when(is_named, F.coalesce(F.nullif("body", F.lit("")), "title")).otherwise(F.col("text"))
        columns = ["source_id", "source_type", "source_key", "project", "title", "url", "updated_at", *({"extra"} & set(self.sources.columns))]
        snippet = headline(shown, terms, stemmed=True).alias("snippet")
        return hits.select(rank.alias("rank"), *columns, snippet, "score", F.when(is_named, F.col("body")).alias("body"))

    def _prompt(self, q: str, hits: DataFrame, max_bytes: int) -> str:
        kept = [attribute(n) if "extra" in hits.columns else F.lit(None).cast("string") for n in ("status", "issue_type", "assignee")]
        head = F.concat(titled(F.col("title")), F.lit(" — "), F.coalesce("url", F.lit("")), F.lit("\n"), meta_line(*kept, F.col("updated_at")))
        entries = hits.select(F.lit(1).alias("query_id"), "rank", head.alias("head"), strip_marks(F.col("snippet")).alias("snippet"), "body")
        row = plans.context(entries, max_bytes).first()
        return f"Context:\n{row['context'] if row else ''}\nQuestion: {q}"

    def prompt(self, q: str, options: SearchOptions = SearchOptions(), *, max_bytes: int = 12000) -> str:
        """The context and the question, as a text within the budget: the one row that comes to the driver."""
        return self._prompt(q, self.search(q, options), max_bytes)

    def messages(self, q: str, options: SearchOptions = SearchOptions(), *, max_bytes: int = 12000, rules: str = RULES) -> list[dict[str, str]]:
        """What a chat model gets: the rules, then the context and the question."""
        return [{"role": "system", "content": rules}, {"role": "user", "content": self.prompt(q, options, max_bytes=max_bytes)}]

    def ask(
        self, q: str, complete: Callable[[str], str], options: SearchOptions = SearchOptions(), *, max_bytes: int = 12000,
    ) -> tuple[str, DataFrame]:
        """A model's answer, and its citations, both from one search; its rows, at most 50, are written once in between."""
        hits = materialize(self.search(q, options), "hits")
        return complete(self._prompt(q, hits, max_bytes)), hits.drop("body")

    def projects(self, source_type: str | None = None) -> DataFrame:
        rows = self.sources.where(F.col("project").isNotNull())
        return (rows.where(F.col("source_type") == source_type) if source_type else rows).select("project").distinct().orderBy("project")

    def source(self, identifier: str) -> DataFrame:
        """The source with an id such as jira:ZOO-1; none for what isn't one."""
        kind, key = split_source_id(F.lit(identifier))
        return self.sources.where((F.col("source_type") == kind) & (F.col("source_key") == key)).withColumn("id", source_id(F.col("source_type"), F.col("source_key")))
