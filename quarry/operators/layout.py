"""Page layout: words to lines, tables to Markdown, and both to a page's text; arrays in, strings out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import stripped

WORDS = "array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>"
BOX = "array<struct<x0:double,top:double,x1:double,bottom:double>>"


def outside(words: Column, boxes: Column, tolerance: float = 2.0) -> Column:
    """The words that no box holds, within a tolerance at every edge."""
    t = F.lit(tolerance)

    def within(w: Column, b: Column) -> Column:
        return (w["x0"] >= b["x0"] - t) & (w["x1"] <= b["x1"] + t) & (w["top"] >= b["top"] - t) & (w["bottom"] <= b["bottom"] + t)

    return F.filter(words, lambda w: ~F.exists(F.coalesce(boxes, F.array().cast(BOX)), lambda b: within(w, b)))


def lines(words: Column, tolerance: float = 3.0) -> Column:
    """Words (``WORDS``) put into lines from the top down; a line's words are those near its *first* word, from left to right."""
    ordered = F.array_sort(F.transform(words, lambda w, k: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), k.alias("k"), w["text"].alias("text"))))

    def step(state: Column, w: Column) -> Column:
        same = state["anchor"].isNotNull() & (F.abs(w["top"] - state["anchor"]) <= tolerance)
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        item = F.struct(line.alias("line"), w["x0"].alias("x0"), w["top"].alias("top"), w["k"].alias("k"), w["text"].alias("text"))
        return F.struct(F.when(same, state["anchor"]).otherwise(w["top"]).alias("anchor"), line.alias("line"), F.concat(state["items"], F.array(item)).alias("items"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,x0:double,top:double,k:int,text:string>>").alias("items"))
    items = F.array_sort(F.aggregate(ordered, start, step, lambda s: s["items"]))
    numbers = F.array_distinct(F.transform(items, lambda i: i["line"]))
    return F.array_join(F.transform(numbers, lambda n: F.array_join(F.transform(F.filter(items, lambda i: i["line"] == n), lambda i: i["text"]), " ")), "\n")


def markdown(rows: Column) -> Column:
    """A ragged table of strings as Markdown; null cells are empty, empty rows go, and an empty table is ''."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(stripped(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    written = F.transform(kept, lambda r: line(r))
    whole = F.array_join(F.concat(F.slice(written, 1, 1), F.array(rule), F.slice(written, 2, F.greatest(F.size(written) - 1, F.lit(0)))), "\n")
    return F.when(F.size(kept) > 0, whole).otherwise("")


def page_text(loose: Column, tables: Column) -> Column:
    """A page's text outside tables and then its tables (array of Markdown strings), as blocks."""
    first = stripped(F.coalesce(loose, F.lit("")))
    return F.array_join(F.filter(F.concat(F.array(first), F.coalesce(tables, F.array().cast("array<string>"))), lambda b: b != ""), "\n\n")
