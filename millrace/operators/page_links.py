"""Resolution of the page marks that markup conversion leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = r"(⟦pg-(?:id|title):[^⟧]*⟧)"


def resolved(bodies: DataFrame, pages: DataFrame, *, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """Marks become [label](url) where their page is known, else their label.

    ``pages`` has number, space, title, url. Marks are exploded with their position and looked up by number, or by
    space and title (the least url if a title is found twice, or in any space where the mark names none); texts are put
    together from their parts, as many as a body has marks. Only bodies with marks take part in the joins.
    """
    marks = F.regexp_extract_all(body_col, F.lit(MARK), F.lit(1))
    parts = F.split(body_col, MARK)
    each = bodies.where(F.size(marks) > 0).select(id_col, F.posexplode(marks).alias("pos", "mark"))
    inner = F.regexp_replace("mark", r"^⟦pg-(id|title):|⟧$", "")
    f, by_number = F.split(inner, r"\|"), F.col("mark").startswith("⟦pg-id:")
    each = each.select(
        id_col, "pos", F.when(by_number, f[0]).alias("number"), F.when(~by_number, f[0]).alias("space"),
        F.when(~by_number, f[1]).alias("title"), F.element_at(f, -1).alias("label"),
    )
    numbers = pages.groupBy(F.col("number").cast("string").alias("number")).agg(F.min("url").alias("by_number"))
    titles = pages.groupBy("space", "title").agg(F.min("url").alias("by_title"))
    anywhere = pages.groupBy("title").agg(F.min("url").alias("by_any")).withColumn("space", F.lit(""))
    found = each.join(numbers, "number", "left").join(titles, ["space", "title"], "left").join(anywhere, ["space", "title"], "left")
    url = F.coalesce("by_number", "by_title", "by_any")
    text = F.when(url.isNotNull(), F.concat(F.lit("["), F.col("label"), F.lit("]("), url, F.lit(")"))).otherwise(F.col("label"))
    lists = found.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"],
    ).alias("_texts"))
    joined = bodies.join(lists, id_col, "left")
    whole = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(F.get(F.col("_texts"), i), F.lit(""))))), "")
    return joined.withColumn(body_col, F.when(F.col("_texts").isNull(), F.col(body_col)).otherwise(whole)).drop("_texts")
