"""Markup, marks of links, snippets, lexemes, vectors and feeds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import lexemes, query_lexemes
from ..functions.headline import headline
from ..functions.text import tokens, trimmed_lines
from ..operators import embed, markup, page_links, records
from ..sources import feeds
from ..sources.corpus import table
from ..streaming.sync import shared_folder
from .registry import register
from .search import ERIN, ERST

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

LINES_SQL = """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), p AS (SELECT doc_id, n, trim(line) AS line FROM l WHERE trim(line) <> '') """
#: One tree with every kind of node, and one page with every kind of element; {d} is the number of the document.
TREE_NODES = """{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"Doc {d}"}]},
{"type":"heading","attrs":{"level":"deep"},"content":[{"type":"text","text":"Odd level"}]},
{"type":"paragraph","content":[{"type":"text","text":"bold","marks":[{"type":"strong"}]},{"type":"text","text":" "},
 {"type":"text","text":"x","marks":[{"type":"code"}]},{"type":"text","text":" "},{"type":"text","text":"slanted","marks":[{"type":"em"}]},
 {"type":"hardBreak"},{"type":"text","text":"all","marks":[{"type":"link","attrs":{"href":"u/{d}"}},{"type":"em"},{"type":"strong"},{"type":"code"}]}]},
{"type":"paragraph","content":[{"type":"mention","attrs":{"text":"@Kim"}},{"type":"mention","attrs":{"displayName":"Lee"}},{"type":"mention"},
 {"type":"text","text":" "},{"type":"inlineCard","attrs":{"url":"u/{d}"}},{"type":"emoji","attrs":{"shortName":":tea:"}}]},
{"type":"blockquote","content":[{"type":"paragraph","content":[{"type":"text","text":"said"}]},{"type":"paragraph","content":[{"type":"text","text":"twice"}]}]},
{"type":"panel","attrs":{"panelType":"caution"},"content":[{"type":"paragraph","content":[{"type":"text","text":"mind"}]},{"type":"rule"}]},
{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"one"}]},
  {"type":"orderedList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"inner"}]}]}]}]},
 {"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"two"}]},{"type":"codeBlock","attrs":{"language":"go"},"content":[{"type":"text","text":"f()"}]}]}]},
{"type":"mediaSingle"},{"type":"unheardOf","content":[{"type":"paragraph","content":[{"type":"text","text":"un"}]},{"type":"paragraph","content":[{"type":"text","text":"known"}]}]},
{"type":"table","content":[{"type":"tableRow","content":[{"type":"tableCell","content":[{"type":"paragraph","content":[{"type":"text","text":"a|b"}]}]}]},
 {"type":"tableRow","content":[{"type":"tableHeader","content":[{"type":"paragraph","content":[{"type":"text","text":"h"}]}]},{"type":"tableHeader","content":[]}]}]}"""
TREE_TEXT = """## Doc {d}

# Odd level

**bold** `x` *slanted*  
[***`all`***](u/{d})

@Kim@Lee@user [u/{d}](u/{d}):tea:

> said

> twice

> **Caution:** mind

> ---

- one
  1. inner
- two
```go
f()
```


un

known

| h |  |
| --- | --- |
| a\\|b |  |

"""
PAGE_HTML = """<h1>Doc {d}</h1><p>Plain <strong>bold</strong>, <em>slanted</em>, <code>x</code>, <a href="u/{d}">all</a><br/>and&nbsp;on.</p>
<ac:structured-macro ac:name="toc"/><ac:structured-macro ac:name="note"><ac:rich-text-body><p>mind</p></ac:rich-text-body></ac:structured-macro>
<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">go</ac:parameter><ac:plain-text-body><![CDATA[f() < {d}
]]></ac:plain-text-body></ac:structured-macro>
<blockquote><p>said</p><p>twice</p></blockquote><ol><li>one<ul><li><p>inner</p></li></ul></li><li>two</li></ol>
<p><ac:link><ri:page ri:content-id="{d}"/></ac:link> <ac:link><ri:page ri:content-title="Home" ri:space-key="S"/></ac:link> <ac:link><ri:user/></ac:link></p>
<ac:structured-macro ac:name="other"><ac:rich-text-body><p>kept</p></ac:rich-text-body></ac:structured-macro>
<table><tbody><tr><th>h</th><th>i</th></tr><tr><td>a|b</td></tr></tbody></table>"""
PAGE_TEXT = """# Doc {d}

Plain **bold**, *slanted*, `x`, [all](u/{d})  
and on.

> **Note:** mind

```go
f() < {d}
```

> said

> twice

1. one
  - inner
2. two

⟦pg-id:{d}|page {d}⟧ ⟦pg-title:S|Home|Home⟧ @user

kept

| h | i |
| --- | --- |
| a\\|b |  |

"""


def _numbered(text: str) -> str:
    """SQL for a text with the number of the document in it."""
    return "replace('" + text.replace("'", "''").replace("\\\\", "\\") + "', '{d}', CAST(doc_id AS VARCHAR))"


def _with_number(text: str):
    return F.replace(F.lit(text.replace("\\\\", "\\")), F.lit("{d}"), F.col("doc_id").cast("string"))


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", trimmed_lines(F.col("text")).alias("lines"))


@query(LINES_SQL + f"SELECT doc_id, md5({_numbered(TREE_TEXT)} || string_agg(line, chr(10) || chr(10) ORDER BY n) || chr(10)) AS markdown_md5 FROM p GROUP BY doc_id")
def tree_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON trees with every kind of node, rendered as markdown."""
    d = _paragraphs(spark, folder).where(F.size("lines") > 0)
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    body = F.to_json(F.transform("lines", lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(text(x)).alias("content"))))
    tree = F.concat(F.lit('{"type":"doc","content":['), _with_number(TREE_NODES), F.lit(","), F.expr("substring(b, 2)"), F.lit("}"))
    return d.withColumn("b", body).select("doc_id", F.md5(markup.tree_markdown(tree)).alias("markdown_md5"))


@query(LINES_SQL + f"SELECT doc_id, md5({_numbered(PAGE_TEXT)} || string_agg('- ' || line, chr(10) ORDER BY n) || chr(10)) AS markdown_md5 FROM p GROUP BY doc_id")
def storage_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as storage XHTML with every kind of element, rendered as markdown."""
    from ..functions.text import html_escaped

    d = _paragraphs(spark, folder).where(F.size("lines") > 0)
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li><p>"), html_escaped(x), F.lit("</p></li>"))), "")
    page = F.concat(_with_number(PAGE_HTML), F.lit("<ul>"), items, F.lit("</ul>"))
    return d.select("doc_id", F.md5(markup.storage_markdown(page)).alias("markdown_md5"))


@query("""WITH t AS (SELECT lang, source AS title, min('u/' || doc_id) AS url FROM documents WHERE n_chars > 3000 GROUP BY ALL)
SELECT d.doc_id, 'See ' || CASE WHEN p.doc_id IS NOT NULL THEN '[next](u/' || p.doc_id || ')' ELSE 'next' END || ' and ' || CASE WHEN t.url IS NOT NULL THEN '[' || d.source || '](' || t.url || ')' ELSE d.source END || '.' AS body
FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id + 1 AND p.n_chars > 3000 LEFT JOIN t ON t.lang = d.lang AND t.title = d.source""")
def page_link_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of links to pages by number and by title, resolved where the page is long enough to be stored."""
    d = table(spark, folder, "documents")
    number = lambda n: (F.col("doc_id") + n).cast("string")
    pages = d.where("n_chars > 3000").select(
        F.col("doc_id").alias("number"), F.col("lang").alias("space"), F.col("source").alias("title"),
        F.concat(F.lit("u/"), number(0)).alias("url"),
    )
    body = F.concat(
        F.lit("See ⟦pg-id:"), number(1), F.lit("|next⟧ and ⟦pg-title:"), F.col("lang"), F.lit("|"), F.col("source"), F.lit("|"),
        F.col("source"), F.lit("⟧."),
    )
    return page_links.resolved(d.select("doc_id", body.alias("body")), pages).select("doc_id", "body")


#: The rules of a snippet: covers of both words, each cut to 40 words or stretched to 20 and on to a word that is long enough or matches.
HEADLINE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
words AS (SELECT r, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
said AS (SELECT *, regexp_extract_all(lower(word), '[a-z0-9]+') AS t FROM words),
marked AS (SELECT r, size, i, list_contains(t, 'the') AS x, list_contains(t, 'of') AS y, length(word) > 3 OR list_contains(t, 'the') OR list_contains(t, 'of') AS good FROM said),
lasts AS (
  SELECT r, size, i, max(CASE WHEN x THEN i END) OVER w AS px, max(CASE WHEN y THEN i END) OVER w AS py, x OR y AS hit
  FROM marked WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), cover AS (
  SELECT r, size, least(px, py) AS a, min(i) AS b FROM lasts WHERE hit AND px IS NOT NULL AND py IS NOT NULL GROUP BY r, size, least(px, py)
), lists AS (SELECT r, list(i ORDER BY i) FILTER (good) AS g, list(i ORDER BY i) FILTER (x OR y) AS h FROM marked GROUP BY r
), near AS (
  SELECT c.*, list_filter(g, lambda j: j >= greatest(a - 40, 0) AND j <= b + 40) AS g, h FROM cover c JOIN lists USING (r)
), stretched AS (
  SELECT r, size, a, h, g, CASE WHEN b - a + 1 > 40 THEN coalesce(list_max(list_filter(g, lambda j: j >= a + 19 AND j <= a + 39)), a + 19)
    ELSE coalesce(list_min(list_filter(g, lambda j: j >= greatest(b, a + 19) AND j < least(a + 40, size))), least(a + 40, size) - 1) END AS e FROM near
), spans AS (
  SELECT r, h, e, CASE WHEN e - a + 1 >= 20 THEN a ELSE coalesce(list_max(list_filter(g, lambda j: j <= least(a, greatest(e - 19, 0)) AND j >= greatest(e - 39, 0))), greatest(e - 39, 0)) END AS s FROM stretched
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY len(list_filter(h, lambda j: j >= s AND j <= e)) DESC, s, e) AS n FROM spans
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_transform(w[coalesce(s, 0) + 1 : coalesce(e, 19) + 1],
    lambda x, i: CASE WHEN list_has_any(regexp_extract_all(lower(x), '[a-z0-9]+'), ['the', 'of']) THEN '<mark>' || x || '</mark>' ELSE x END), ' '), '') END AS snippet
FROM d LEFT JOIN ranked ON ranked.r = d.r AND n = 1"""


@query(HEADLINE_SQL)
def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets of all documents around covers of two words."""
    return table(spark, folder, "documents").select("doc_id", headline(F.col("text"), ["the", "of"]).alias("snippet"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id FROM t GROUP BY doc_id HAVING count(*) FILTER (w IN {ERST}) > 0 AND count(*) FILTER (w IN {ERIN}) > 0""")
def fts_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all lexemes of an English question, stop words aside; words are stemmed once each."""
    wanted = query_lexemes("the ersted and the erines of erst")
    words = table(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    hits = lexemes(words).where(F.col("lexeme").isin(*wanted))
    found = words.join(hits, "word").groupBy("doc_id").agg(F.countDistinct("lexeme").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("doc_id")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS a, sha256(unhex(sha256(text))) AS b FROM documents), hh AS (SELECT doc_id, a || b AS x, sha256(unhex(b)) AS c FROM h),
s AS (SELECT doc_id, x || c || sha256(unhex(c)) AS x FROM hh),
v AS (SELECT doc_id, list_transform(range(32), lambda i: ('0x' || substr(x, 8 * i + 7, 2) || substr(x, 8 * i + 5, 2) || substr(x, 8 * i + 3, 2) || substr(x, 8 * i + 1, 2))::BIGINT / 2147483648::DOUBLE - 1) AS v FROM s)
SELECT doc_id, unnest(range(32))::INT AS position, round(unnest(list_transform(v, lambda y: (y / sqrt(list_sum(list_transform(v, lambda z: z * z))))::FLOAT::DOUBLE)), 5) AS value FROM v""")
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Test vectors of all documents, a row for each component."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    found = embed.embed(d, partial(embed.hash_batch, dimension=32), dimension=32)
    return found.select("doc_id", F.posexplode("embedding").alias("position", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("""WITH c AS (SELECT DISTINCT md5('m|' || text) AS key FROM documents WHERE lang = 'en')
SELECT doc_id, md5('m|' || text) IN (SELECT key FROM c) AS hit, 8 AS dimension, 1 AS kept FROM documents WHERE text IS NOT NULL""")
def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Documents embedded through a cache, which has English ones and, of another length, French ones; and what it keeps of each afterwards."""
    from ..functions.vectors import cache_key

    d = table(spark, folder, "documents").where("text is not null")
    vector = F.when(F.col("lang") == "en", F.array_repeat(F.lit(0.5), 8)).otherwise(F.array_repeat(F.lit(0.5), 3))
    cache = d.where("lang in ('en', 'fr')").select(cache_key("", "m", F.col("text")).alias("key"), vector.alias("vector")).distinct()
    whole, after = embed.through_cache(d.select("doc_id", "text"), cache, partial(embed.hash_batch, dimension=8), model="m", dimension=8)
    kept = after.groupBy("key").agg(F.count("*").cast("int").alias("kept"))
    return whole.join(kept, "key", "left").select("doc_id", "hit", F.size("embedding").alias("dimension"), "kept")


@query("""SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system' AND (conv_id % 5 > 0 OR turn < 2)), '')) AS answer_md5,
  CASE WHEN conv_id % 5 = 0 AND max(turn) >= 2 THEN 'overloaded' END AS error FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system' OR turn = 2 AND conv_id % 5 = 0) > 0""")
def token_stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Answers put together from streamed pieces; every fifth ends with an error at its third turn."""
    m = table(spark, folder, "conversations")
    piece = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    failed = F.to_json(F.struct(F.struct(F.lit("overloaded").alias("message")).alias("error")))
    line = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 2), F.concat(F.lit("data:"), failed)).when(
        F.col("role") == "system", F.lit(": ping")).otherwise(F.concat(F.lit("data: "), piece))
    ends = m.select("conv_id").distinct().select("conv_id", F.lit(1 << 40).alias("turn"), F.lit("data: [DONE]").alias("line"))
    found = records.folded(m.select("conv_id", "turn", line.alias("line")).unionByName(ends), key="conv_id", order="turn")
    return found.select("conv_id", F.md5("text").alias("answer_md5"), "error")


@query("SELECT o_orderkey AS number, split_part(o_orderpriority, '-', 1) AS prefix, o_custkey AS customer FROM orders WHERE o_orderstatus <> 'P' AND split_part(o_orderpriority, '-', 1) IN ('1', '3')")
def landed_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders landed as JSON lines, some broken, read back with a schema and filtered by allowed prefixes."""
    folder_out = shared_folder(spark)
    o = table(spark, folder, "orders")
    line = F.when(F.col("o_orderstatus") == "P", F.lit("{broken")).otherwise(F.to_json(F.struct(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("customer"),
    )))
    o.select(line.alias("value")).write.text(folder_out)
    got = feeds.landed(spark, folder_out, "number long, key string, customer long").where("_bad is null")
    return feeds.allowed_prefixes(got, ["1", "3"]).select("number", F.split_part("key", F.lit("-"), F.lit(1)).alias("prefix"), "customer")


@query("""WITH RECURSIVE p AS (SELECT doc_id AS id, doc_id // 2 AS parent FROM documents WHERE doc_id > 0), c AS (
  SELECT id, parent AS top, 1 AS depth FROM p WHERE parent > 0 UNION ALL SELECT c.id, p.parent, depth + 1 FROM c JOIN p ON p.id = c.top WHERE p.parent > 0)
SELECT p.id, coalesce(max(depth), 0) AS depth, coalesce(sum(top)::BIGINT, 0) AS total FROM p LEFT JOIN c USING (id) GROUP BY p.id""")
def ancestor_chains(spark: SparkSession, folder: str) -> DataFrame:
    """All ancestors of each page, root first, by doubling joins; half of a page's number is its parent's."""
    pages = table(spark, folder, "documents").where("doc_id > 0").select(
        F.col("doc_id").alias("id"), F.expr("nullif(doc_id div 2, 0)").alias("parent_id"),
    )
    chain = feeds.ancestors(pages)
    return chain.where("complete").select(
        "id", F.size("path").alias("depth"), F.aggregate("path", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
    )
