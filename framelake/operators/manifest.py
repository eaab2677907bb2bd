"""Manifests: link lists and box trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import looks_like_link


def parse_links(lines: DataFrame) -> DataFrame:
    """line_no, link, comment, blank: the first # ends the link; trailing commas, then one pair of matching quotes are stripped; comments and blank lines stay."""
    raw = F.trim(F.substring_index("line", "#", 1))
    bare = F.trim(F.regexp_replace(raw, r"[,\s]+$", ""))
    quoted = (F.length(bare) >= 2) & (((bare.startswith('"')) & bare.endswith('"')) | (bare.startswith("'") & bare.endswith("'")))
    link = F.when(quoted, F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    has = F.instr("line", "#") > 0
    comment = F.when(has, F.trim(F.substring(F.col("line"), F.instr("line", "#") + 1, F.length("line"))))
    return lines.select("line_no", link.alias("link"), comment.alias("comment"), (~has & (link == "")).alias("blank"))


def links_only(links: DataFrame) -> DataFrame:
    return links.where("link <> ''").withColumn("valid", looks_like_link("link"))


def render_links(links: DataFrame, key: str | None = None) -> DataFrame:
    """The list as text, a newline after every line: link and ten spaces before a comment, comment alone, blank. With `key`, a text for each list."""
    line = F.when((F.col("link") != "") & F.col("comment").isNotNull(), F.concat("link", F.lit(" " * 10 + "# "), "comment")).when(F.col("link") != "", F.col("link")).when(F.col("comment").isNotNull(), F.concat(F.lit("# "), F.col("comment"))).otherwise("")
    g = links.withColumn("text_line", line)
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text_line"))), lambda s: s["text_line"]), "\n"), F.lit("\n")).alias("text")
    return g.groupBy(*([key] if key else [])).agg(joined)


def find_path(tree: DataFrame, path: str) -> DataFrame:
    """The first node (smallest id) of each type down a slash path, as far as it goes: level, id, type. tree: id, parent (null at the top), type.

    One recursive query however long the path is: of the nodes only the first child of each type and parent takes part, so that a level is
    one lookup. Empty parts of the path are passed over.
    """
    kinds = [k for k in path.split("/") if k]
    firsts = tree.where(F.col("type").isin(kinds)).groupBy("parent", "type").agg(F.min("id").alias("id"))
    return tree.sparkSession.sql(
        """
        WITH RECURSIVE walk(level, id, type) AS (
            SELECT 0, id, type FROM {firsts} WHERE parent IS NULL AND type = get(:kinds, 0)
            UNION ALL
            SELECT w.level + 1, f.id, f.type FROM walk w JOIN {firsts} f ON f.parent = w.id AND f.type = get(:kinds, w.level + 1))
        SELECT level, id, type FROM walk""",
        args={"kinds": F.array(*[F.lit(k) for k in kinds] or [F.lit("")])},
        firsts=firsts,
    )


def children_of_type(tree: DataFrame, parent: int, kind: str) -> DataFrame:
    return tree.where((F.col("parent") == parent) & (F.col("type") == kind))
