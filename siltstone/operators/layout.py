"""Page layout: words into rows, boxes of rows, overlaps, and classes of text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Space between words that parts the cells of a row, between starts of one column, and between lines of one block.
CELL_GAP, COLUMN_SHIFT, LINE_GAP = 15.0, 5.0, 12.0
#: Words whose tops differ by no more than this from the first of a row stand in it (fixed value).
ROW_HEIGHT = 5.0


def word_rows(words: DataFrame, height: float = ROW_HEIGHT, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``row`` (from 0) to words (page long, top, x0, x1, bottom doubles, and strings named in ``also``).

    Words are read down a page; one that is further than ``height`` from the first word of the
    current row opens the next. Sorted partitions are streamed, so a page may be of any length.
    """
    columns = ["page", "top", "x0", "x1", "bottom"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, anchor, row, started = None, 0.0, 0, False
        for batch in batches:
            rows = []
            for p, top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or p != page:
                    page, anchor, row, started = p, top, 0, True
                elif abs(top - anchor) > height:
                    anchor, row = top, row + 1
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], names=[*columns, *also, "row"])

    typed = words.select(F.col("page").cast("long").alias("page"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns[1:]), *(F.col(c).cast("string").alias(c) for c in also))
    dealt = typed.repartition("page").sortWithinPartitions("page", "top", "x0", "x1", "bottom", *also)
    return dealt.mapInArrow(number, "page long, top double, x0 double, x1 double, bottom double, " + "".join(f"{c} string, " for c in also) + "row long")


def row_boxes(rows: DataFrame) -> DataFrame:
    """The box around each row, and how many words it holds."""
    return rows.groupBy("page", "row").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("n_words"))


def overlap(a: str, b: str) -> Column:
    """Whether two boxes touch or overlap; columns are named by suffix."""
    apart = [F.col(f"{x1}_{a}") < F.col(f"{x0}_{b}") for x0, x1 in (("x0", "x1"), ("top", "bottom"))] + [F.col(f"{x0}_{a}") > F.col(f"{x1}_{b}") for x0, x1 in (("x0", "x1"), ("top", "bottom"))]
    return ~(apart[0] | apart[1] | apart[2] | apart[3])


def overlapping_rows(boxes: DataFrame) -> DataFrame:
    """(page, row_a, row_b): pairs of boxes of a page that overlap; a join on the page."""
    sides = [boxes.select("page", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "x0", "top", "x1", "bottom"))) for s in "ab"]
    return sides[0].join(sides[1], "page").where((F.col("row_a") < F.col("row_b")) & overlap("a", "b")).select("page", "row_a", "row_b")


def block_class(text: Column) -> Column:
    """title, heading, list_item, table, reference, paragraph or unknown; titles are tried first."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    shouted = (F.upper(t) == t) & (F.lower(t) != t)
    title = (F.length(t) < 100) & (shouted | F.startswith(t, F.lit("#")) | F.rlike(t, F.lit(r"\A[A-Z][^.!?]*\z")))
    return (
        F.when(t == "", "unknown")
        .when(title, "title")
        .when(F.rlike(t, F.lit(r"^#{1,6}\s+")), "heading")
        .when(F.rlike(t, F.lit(r"^\d+\.\s+")), "list_item")
        .when(F.length(t) - F.length(F.replace(t, F.lit("|"))) > 2, "table")
        .when(F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")), "reference")
        .otherwise("paragraph")
    )


def row_cells(words: DataFrame, gap: float = CELL_GAP) -> DataFrame:
    """(page, row, x0, top, x1, bottom, cells, starts, text): rows of words (page, top, x0, x1, bottom, text) with their cells from left to right.

    A cell ends where the next word begins more than ``gap`` behind it. Blank and null texts
    are left out of texts and cells.
    """
    rows = word_rows(words, also=("text",)).where(F.rlike("text", F.lit(r"\S")))
    held = F.array_sort(F.collect_list(F.struct("x0", "x1", "top", "bottom", "text")))
    g = rows.groupBy("page", "row").agg(F.min("x0").alias("left"), F.min("top").alias("top"), F.max("x1").alias("right"), F.max("bottom").alias("bottom"), held.alias("w"))
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.coalesce(F.get("w", i)["x0"] - F.get("w", i - 1)["x1"] > gap, F.lit(False)))
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("a"), F.concat(cuts, F.array(F.size("w"))).alias("b"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.trim(x["text"])), " ")
    cells = F.transform(spans, lambda s: joined(F.slice("w", s["a"] + 1, s["b"] - s["a"])))
    return g.select("page", "row", F.col("left").alias("x0"), "top", F.col("right").alias("x1"), "bottom", cells.alias("cells"), F.transform(spans, lambda s: F.get("w", s["a"])["x0"]).alias("starts"), joined(F.col("w")).alias("text"))


def tables(rows: DataFrame, shift: float = COLUMN_SHIFT) -> DataFrame:
    """Adds ``table`` to ``row_cells``: the first row of a run of rows with as many cells, two or more, that begin in the same columns; null for others."""
    w = Window.partitionBy("page").orderBy("row")
    before, n = F.lag("starts").over(w), F.size("starts")
    near = F.forall(F.zip_with("starts", before, lambda a, b: F.abs(a - b)), lambda d: F.coalesce(d <= shift, F.lit(False)))
    follows = F.coalesce((n >= 2) & (n == F.size(before)) & near, F.lit(False))
    d = rows.withColumn("_f", follows).withColumn("_g", F.max(F.when(~F.col("_f"), F.col("row"))).over(w))
    size = F.count("*").over(Window.partitionBy("page", "_g"))
    return d.withColumn("table", F.when((size >= 2) & (n >= 2), F.col("_g"))).drop("_f", "_g")


def page_blocks(words: DataFrame, line_gap: float = LINE_GAP) -> DataFrame:
    """(page, block, layout_type, text, x0, top, x1, bottom, n_rows, n_columns): blocks of a page from above.

    A table is a block, its rows parted by line breaks and its cells by tabs. Rows of running
    text whose boxes overlap from side to side and stand no more than ``line_gap`` apart are one
    paragraph; rows of other classes are blocks of their own. Null positions count 0; repeated
    words stand beside each other; an empty table gives an empty one.
    """
    d = tables(row_cells(words))
    d = d.withColumn("layout_type", F.when(F.col("table").isNotNull(), "table").otherwise(block_class(F.col("text"))))
    w = Window.partitionBy("page").orderBy("row")
    last = lambda c: F.lag(c).over(w)
    beside = ~((F.col("x1") < last("x0")) | (F.col("x0") > last("x1")))
    runs_on = (F.col("layout_type") == "paragraph") & (last("layout_type") == "paragraph") & (F.col("top") - last("bottom") <= line_gap) & beside
    same = F.coalesce(runs_on | (F.col("table") == last("table")), F.lit(False))
    d = d.withColumn("block", F.sum((~same).cast("long")).over(w) - 1)
    line = F.when(F.col("table").isNotNull(), F.array_join("cells", "\t")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))), lambda x: x["t"]), "\n")
    return d.groupBy("page", "block").agg(F.first("layout_type").alias("layout_type"), text.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("n_rows"), F.max(F.size("cells")).cast("long").alias("n_columns"))


def heading_tree(headings: DataFrame, key: str = "doc_id", order: str = "position", level: str = "level", text: str = "text") -> DataFrame:
    """Adds ``parent`` (the place of the nearest heading before it of a lower level, null at the root) and ``path`` (texts from the outermost on).

    What a stack would hold is told by the last places of the six levels: a level's last
    heading is still open if none of a lower level came after it. Levels outside 1 to 6 are 1.
    Order must be unique in a document.
    """
    d = headings.withColumn("_l", F.when(F.col(level).between(1, 6), F.col(level)).otherwise(1))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("_l") == k, F.struct(F.col(order).alias("at"), F.col(text).alias("t"))), ignorenulls=True).over(w) for k in range(1, 7)]
    d = d.withColumn("_s", F.array(*last))
    lower = F.slice("_s", 1, F.greatest(F.col("_l") - 1, F.lit(0)))
    open_ = F.filter(lower, lambda x, k: x.isNotNull() & ~F.exists(F.slice("_s", 1, k), lambda y: F.coalesce(y["at"] > x["at"], F.lit(False))))
    d = d.withColumn("_o", open_)
    return d.withColumns({"parent": F.array_max(F.transform("_o", lambda x: x["at"])), "path": F.concat(F.transform("_o", lambda x: x["t"]), F.array(F.col(text)))}).drop("_l", "_s", "_o")
