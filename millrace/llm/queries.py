"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tokenizer_file


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in 5 documents or more stay only in the largest doc_id."""
    from .line_dedup import line_dedup

    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(k.doc_id < f.keeper, false) AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and network addresses, card and phone numbers of every document."""
    from .pii import find_personal_data

    found = find_personal_data(documents(spark, sf_dir))
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",",
    )
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; those with more than 2048 are marked."""
    from .token_counts import token_counts

    counts = token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    from .ann import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from .ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4, threshold=Fraction(85, 100))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ') || ' ' || least(len(w), 4)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS top FROM documents UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(top) AS component_id FROM r GROUP BY v) t USING (doc_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    from .quality import quality_rules

    found = quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def remainder(c: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null stays null."""
    return F.crc32(F.col(c).cast("string")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, learned from three of four documents."""
    from .language_id import identify, learn

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_set")


#: Words of a gram in the language model. Three take more disk than the check allows (see the README).
KATZ_ORDER = 2


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz scores of all documents, learned from four of five."""
    from .katz import katz_scores

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    scores = katz_scores(docs, ~held_out, order=KATZ_ORDER)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all documents when sources are mixed by the square roots of their bytes."""
    from .mixing import mix

    docs = documents(spark, sf_dir).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return mix(docs, size_col="n_bytes")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token ids of all documents in sequences of at most 1024."""
    from .packing import pack

    pieces = pack(documents(spark, sf_dir), "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 16 parts, 64 entries each, two rounds."""
    from .common import materialize
    from .vector_codes import encode, fit

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    codebooks = fit(vectors, parts=16, entries=64, rounds=2)
    coded = materialize(encode(vectors, codebooks).select("vec_id", "label", "code", "error"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment ``a{n}`` of all parts to codebooks ``c{n}``; a least distance and its first entry in one number."""
    return f"""
a{n} AS (
  SELECT r, vec_id, label, p, v, m % 64 AS e, m // 64 AS d FROM (
    SELECT r, any_value(x.vec_id) AS vec_id, any_value(x.label) AS label, p, any_value(x.v) AS v,
           min(((x.v[1] - c.v[1]) * (x.v[1] - c.v[1]) + (x.v[2] - c.v[2]) * (x.v[2] - c.v[2]) + (x.v[3] - c.v[3]) * (x.v[3] - c.v[3]) + (x.v[4] - c.v[4]) * (x.v[4] - c.v[4])) * 64 + c.e) AS m
    FROM x JOIN c{n} c USING (p) GROUP BY r, p
  )
)"""


def _moved_sql(n: int) -> str:
    mean = ", ".join(f"(sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) // count(*)" for j in range(1, 5))
    return f"""
c{n} AS (
  SELECT p, e, coalesce(m.v, o.v) AS v FROM c{n - 1} o LEFT JOIN (SELECT p, e, [{mean}]::BIGINT[] AS v FROM a{n - 1} GROUP BY p, e) m USING (p, e)
)"""


OP11_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (SELECT r, vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS v FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, r AS e, v FROM x WHERE r < 64), {_round_sql(0)}, {_moved_sql(1)}, {_round_sql(1)}, {_moved_sql(2)}, {_round_sql(2)},
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c2),
f AS (
  SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM s) AS codebooks_sha256 FROM f
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more found five times, each with the frequent word it may be a misspelling of."""
    from .spelling import variants, word_counts

    return variants(word_counts(documents(spark, sf_dir), min_chars=6, min_count=5, slip=199), ratio=5)


#: The table of crc32 follows from its polynomial; bytes of a letter beyond ASCII are 0xC3 and its code point less 64.
OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS crc FROM range(256) x(b)
), runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
    lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b::BIGINT) + 1]), 4294967295::BIGINT)) AS h
  FROM runs, t
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), pairs AS (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word
), best AS (
  SELECT x, count(*) AS n_near, first(y ORDER BY w.n DESC, y) AS y, max(w.n) AS y_n FROM pairs JOIN w ON w.word = y GROUP BY x
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN y_n >= 5 * w.n THEN y END AS form, CASE WHEN y_n >= 5 * w.n THEN y_n END AS form_n
  FROM w LEFT JOIN best ON x = w.word
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT word, f.form, c.root, n, n_near, form_n FROM formed f JOIN chain c USING (word) WHERE c.next IS NULL
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document within passages of ten words of the benchmark."""
    from .decontaminate import contamination

    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS size FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), placed AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (
  SELECT DISTINCT r, i, size, item FROM placed JOIN (SELECT DISTINCT size FROM g) s ON i + size - 1 <= len(w) JOIN g USING (size) WHERE g = array_to_string(w[i : i + size - 1], ' ')
), covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_personal_data, op3_token_counts, op4_nearest, op5_ngram_join, op6_quality_rules, op7_language_id, op8_lm_scoring,
    op9_mixing, op10_packing, op11_vector_codes, op12_spelling_variants, op13_decontamination,
)}
ORACLES = {
    "op1_line_dedup": OP1_SQL, "op5_ngram_join": OP5_SQL, "op11_vector_codes": OP11_SQL, "op12_spelling_variants": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
