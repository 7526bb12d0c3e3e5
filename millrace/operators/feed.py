"""Record feeds: parse, normalise, and split good rows from bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_prefix, parsed_time

ISSUE = "key string, project string, title string, description string, status string, issue_type string, url string, updated_at string, comments array<struct<author:string,created_at:string,body:string>>, extra map<string,string>, links array<struct<target_type:string,target_key:string,kind:string>>"


def parsed_issues(feed: DataFrame, json_col: str = "json") -> DataFrame:
    """One row for each issue of a feed: normalised fields and ``error``, null for a good row.

    Broken JSON is an error of its row. Key, title and time of update are required; the project falls back to the
    key's prefix; a link's target type to jira; status, issue type and number of comments enter extra where it lacks
    them.
    """
    i = F.from_json(json_col, ISSUE, {"mode": "PERMISSIVE"})
    rows = feed.withColumn("_i", i)
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    key, title, at = blank("_i.key"), blank("_i.title"), parsed_time(F.col("_i.updated_at"))
    error = F.when(F.col("_i").isNull(), "not JSON").when(key == "", "key is required").when(title == "", "title is required").when(at.isNull(), "updated_at is required")
    project = F.when(blank("_i.project") != "", blank("_i.project")).otherwise(key_prefix(key))
    given = F.coalesce("_i.extra", F.create_map().cast("map<string,string>"))
    add = F.map_filter(
        F.create_map(
            F.lit("status"), F.col("_i.status"), F.lit("issue_type"), F.col("_i.issue_type"), F.lit("comment_count"),
            F.coalesce(F.size("_i.comments"), F.lit(0)).cast("string"),
        ),
        lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(given, k),
    )
    links = F.transform(
        F.coalesce("_i.links", F.array().cast("array<struct<target_type:string,target_key:string,kind:string>>")),
        lambda x: F.struct(
            F.when(blank(x["target_type"]) == "", "jira").otherwise(F.trim(x["target_type"])).alias("target_type"),
            F.trim(x["target_key"]).alias("target_key"), F.trim(x["kind"]).alias("kind"),
        ),
    )
    return rows.select(
        *feed.columns, key.alias("key"), title.alias("title"), project.alias("project"), at.alias("updated_at"),
        F.map_concat(given, add).alias("extra"), links.alias("links"), F.col("_i.description").alias("description"),
        F.col("_i.comments").alias("comments"), error.alias("error"),
    )


def comment_text(c):
    """A comment under its heading, which has author and day where they are known."""
    field = lambda name: F.coalesce(c[name], F.lit(""))
    author = F.when(F.trim(field("author")) != "", F.concat(F.lit("by "), c["author"]))
    at = parsed_time(c["created_at"])
    day = F.when(at.isNotNull(), F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd")))
    return F.concat(F.concat_ws(" ", F.lit("\n\n## Comment"), author, day), F.lit("\n\n"), F.regexp_replace(field("body"), r"\n+\z", ""))


def issue_body(description, comments):
    """Description and comments as one markdown text."""
    text = F.regexp_replace(F.coalesce(description, F.lit("")), r"\n+\z", "")
    none = F.array().cast("array<struct<author:string,created_at:string,body:string>>")
    parts = F.transform(F.coalesce(comments, none), lambda c: F.concat(comment_text(c), F.lit("\n")))
    whole = F.concat(F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(""), F.array_join(parts, ""))
    return F.concat(F.regexp_replace(whole, r"\n+\z", ""), F.lit("\n"))


def extracted_links(issues: DataFrame) -> DataFrame:
    """Edges (source_id, target_type, target_key, kind) of issues with parent, subtasks and links.

    ``issues`` has key, parent struct<key, issue_type>, subtasks array<string>, links array<struct<outward_key, outward,
    inward_key, inward>>. Kinds are canonical; loops, blanks and repeats go.
    """
    from ..functions.text import link_kind

    edge = lambda k, kind: F.struct(F.trim(k).alias("target_key"), kind.alias("kind"))
    none = F.array().cast("array<struct<target_key:string,kind:string>>")
    up = F.when(
        F.col("parent.key").isNotNull(),
        F.array(edge(F.col("parent.key"), F.when(F.lower("parent.issue_type") == "epic", "epic").otherwise("parent"))),
    )
    down = F.transform("subtasks", lambda k: edge(k, F.lit("subtask")))
    out = F.transform("links", lambda x: edge(x["outward_key"], link_kind(x["outward"])))
    back = F.transform("links", lambda x: edge(x["inward_key"], link_kind(x["inward"])))
    each = issues.select(
        F.col("key").alias("source_id"), F.explode(F.concat(*[F.coalesce(a, none) for a in (up, down, out, back)])).alias("e"),
    ).select("source_id", "e.*")
    return each.where("target_key != '' and kind != '' and target_key != source_id").select(
        "source_id", F.lit("jira").alias("target_type"), "target_key", "kind",
    ).distinct()
