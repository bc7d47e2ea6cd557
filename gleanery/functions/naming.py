"""File names of pages, and where links lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest name, and the mark of a shortened one.
MAX_NAME, SHORT_MARK = 200, "__TRUNC_"


def path_name(path: Column, prefix: Column | str = "") -> Column:
    """``a/b c.html`` becomes ``a__b_c.md``; the prefix is put in front once."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    last = F.regexp_extract(p, r"([^/]*)$", 1)
    p = F.when(p.rlike(r"(?i)\.html?$"), F.regexp_replace(p, r"(?i)\.html?$", ".md")).when(~F.contains(last, F.lit(".")), F.concat(p, F.lit(".md"))).otherwise(p)
    p = F.replace(F.array_join(F.filter(F.split(p, "/"), lambda s: s != ""), "__"), F.lit(" "), F.lit("_"))
    return F.when((prefix != "") & ~F.startswith(p, prefix), F.concat(prefix, p)).otherwise(p)


def title_name(title: Column, prefix: Column | str = "") -> Column:
    """A title as a file name; empty if nothing of it can stand in one."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    name = F.btrim(F.replace(F.regexp_replace(title, r'[/\\:*?"<>|]', ""), F.lit(" "), F.lit("_")), F.lit("._"))
    return F.when(name == "", "").otherwise(F.concat(prefix, name, F.lit(".md")))


def shortened(name: Column, path: Column) -> Column:
    """Names over ``MAX_NAME`` end in a mark with eight digits of the path's SHA-1 instead."""
    head = MAX_NAME - len(SHORT_MARK) - len(".md") - 8
    short = F.concat(F.substring(F.regexp_replace(name, r"\.md$", ""), 1, head), F.lit(SHORT_MARK), F.substring(F.sha1(path.cast("binary")), 1, 8), F.lit(".md"))
    return F.when(F.length(name) > MAX_NAME, short).otherwise(name)


def disambiguated(pages: DataFrame, name: str = "name", order: tuple[str, ...] = ("source", "path"), out: str = "filename") -> DataFrame:
    """``out``: the name, for its second and later page with ``-2``, ``-3``, ... before the extension.

    Numbers that some page's own name already has are passed over, so no two pages end up alike.
    """
    natural = pages.select(F.col(name).alias("__taken")).distinct()
    base, ext = F.regexp_replace(name, r"\.md$", ""), F.regexp_extract(name, r"(\.md)?$", 1)
    turn = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    numbered = pages.withColumn("__turn", turn)
    # names in use that look like a numbered one of ours
    taken = natural.select(F.concat(F.regexp_extract("__taken", r"^(.*)-\d+(?:\.md)?$", 1), F.regexp_extract("__taken", r"(\.md)?$", 1)).alias("__of"), F.regexp_extract("__taken", r"-(\d+)(?:\.md)?$", 1).try_cast("int").alias("__n")).where("__n >= 2")
    used = taken.groupBy("__of").agg(F.sort_array(F.collect_set("__n")).alias("__used"))
    joined = numbered.join(used, F.col(name) == F.col("__of"), "left").withColumn("__used", F.coalesce("__used", F.array().cast("array<int>")))
    skip = F.aggregate(F.col("__used"), F.col("__turn"), lambda n, u: n + F.when(u <= n, 1).otherwise(0))
    return joined.withColumn(out, F.when(F.col("__turn") == 1, F.col(name)).otherwise(F.concat(base, F.lit("-"), skip.cast("string"), ext))).drop("__turn", "__of", "__used")


def link_keys(path: Column) -> Column:
    """Keys under which a link's target may be found, best first: as it is, then without or with an extension."""
    key = F.lower(F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != ""), "/"))
    bare = F.regexp_replace(key, r"\.html?$", "")
    more = F.when(key.rlike(r"\.html?$"), F.array(bare)).otherwise(F.array(F.concat(key, F.lit(".html")), F.concat(key, F.lit(".htm"))))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(key), more))


def resolved_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """``links`` (with ``path``) and the ``target`` of the first of its keys that ``targets`` (key, target) has, else null."""
    rows = links.withColumn("__id", F.monotonically_increasing_id())
    keys = rows.select("__id", F.posexplode(link_keys(F.col("path"))).alias("__rank", "key"))
    best = keys.join(targets, "key").groupBy("__id").agg(F.min_by("target", "__rank").alias("target"))
    return rows.join(best, "__id", "left").drop("__id")


def titled_parents(pages: DataFrame, path: str = "path", title: str = "title") -> DataFrame:
    """``path`` and ``parent_title``: the title of the nearest titled page above, from the grandparent folder's page up."""
    parts = F.split(path, "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 2)), lambda n: F.when(F.size(parts) - 2 >= n, F.struct(n.alias("depth"), F.lower(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit(".html"))).alias("key")))), lambda s: s.isNotNull())
    rows = pages.select(path, F.explode(above).alias("a")).select(path, "a.depth", "a.key")
    titles = pages.where(F.col(title) != "").select(F.lower(path).alias("key"), F.col(title).alias("__title"))
    found = rows.join(titles, "key").groupBy(path).agg(F.max_by("__title", "depth").alias("parent_title"))
    return pages.select(path).join(found, path, "left").withColumn("parent_title", F.coalesce("parent_title", F.lit("")))
