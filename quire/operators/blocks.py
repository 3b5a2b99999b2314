"""Blocks written out: Markdown, notes at the end, front matter, and the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH = r"(#{1,6})(?=[ \t]|$)"


def block_markdown(kind: Column, text: Column, items: Column, level: Column, page: Column, occurrence: Column, quoted: Column, numbered: Column | None = None, escape_hash: bool = False) -> Column:
    """Markdown of one block of the kinds heading, quote, contents, page, list and paragraph; a numbered paragraph's number is escaped."""
    mark = F.when(F.coalesce(quoted, F.lit(False)), "> - ").otherwise("- ")
    label = F.concat(F.lit("%%page "), page, F.coalesce(F.concat(F.lit("#"), occurrence.cast("string")), F.lit("")), F.lit("%%"))
    plain = text if numbered is None else F.when(F.coalesce(numbered, F.lit(False)), F.regexp_replace(text, r"^(\d+)([.)])", r"$1\\$2")).otherwise(text)
    quote, entries = F.concat(F.lit("> "), text), F.array_join(F.transform(items, lambda x: F.concat(mark, x)), "\n")
    if escape_hash:
        plain = F.regexp_replace(plain, f"^{HASH}", r"\\$1")
        quote = F.regexp_replace(quote, f"^> {HASH}", r"> \\$1")
        entries = F.regexp_replace(entries, f"(?m)^((?:> )?- ){HASH}", r"$1\\$2")
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "quote", quote).when(kind == "contents", F.concat(F.lit("- "), text, F.lit(" — "), page)).when(kind == "page", label).when(kind == "list", entries).otherwise(plain)


def joined(rows: DataFrame, key: str, order: str, text: str, between: str = "\n\n") -> DataFrame:
    """Texts of each key, in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), between).alias("_t")).withColumnRenamed("_t", text)


def merged_notes(notes: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbours of one label as one note, unless numbering starts again there: key, first order, label, text.

    notes: label, text, restart. A text equal to the one before it is not repeated.
    """
    w = W.partitionBy(key).orderBy(order)
    same = F.col("label").eqNullSafe(F.lag("label").over(w)) & ~F.coalesce("restart", F.lit(False)) & (F.row_number().over(w) > 1)
    at = notes.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    texts = F.transform(parts, lambda x: x["text"])
    once = F.filter(F.transform(texts, lambda x, i: F.when((i == 0) | (x != F.get(texts, i - 1)), x)), lambda x: x.isNotNull())
    out = at.groupBy(key, "_run").agg(F.min(order).alias("_o"), F.first("label").alias("label"), F.array_join(once, " ").alias("_t"))
    return out.select(key, F.col("_o").alias(order), "label", F.col("_t").alias("text"))


def endnotes(merged: DataFrame, key: str, order: str) -> DataFrame:
    """The section of notes of each document."""
    return joined(merged.withColumn("endnotes", F.concat(F.lit("[^"), "label", F.lit("]: "), "text")), key, order, "endnotes")


def front_matter(fields: dict[str, Column], numbers: set[str]) -> Column:
    """A header of fields; numbers stand as they are, others in quotes, and null or empty ones are left out."""
    lines = []
    for name, c in fields.items():
        value = c.cast("string") if name in numbers else F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        lines.append(F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{name}: "), value)))
    return F.concat(F.lit("---\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n---"))


def document(head: Column, body: Column, notes: Column) -> Column:
    """Header, body and notes, with at most two empty lines in a row and one line feed at the end."""
    section = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("## Notes\n\n"), notes))
    whole = F.array_join(F.array(F.nullif(head, F.lit("")), F.nullif(body, F.lit("")), section), "\n\n")
    return F.concat(F.regexp_replace(F.regexp_replace(whole, "\n{4,}", "\n\n\n"), "[ \t\n\r\f\x0b]+$", ""), F.lit("\n"))
