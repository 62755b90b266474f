"""Text preparation (T01-T04): segments, reassembly, preview, line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Viewer markers.
TRUNCATED_MARK = "\n...(截斷)"
BLANK_MARK = "(空白)"
PREVIEW_CHARS = 4000
LINE_COUNT_CAP = 2000


def segment_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per newline-separated segment, in order; blank segments
    (``trim == ''``) are flagged, not dropped.  Null text gives no rows."""
    return df.select(
        id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("seg_no", "text")
    ).withColumn("is_blank", F.expr(r"regexp_replace(text, '(?U)^\\s+|\\s+$', '') = ''"))


def reassemble_segments(seg: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        out: str = "text") -> DataFrame:
    """Join the segments of each document back in ``seg_no`` order.
    A document's segments come from one row, so each group is bounded by
    the document itself."""
    return seg.groupBy(id_col).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seg_no", F.col(text_col).alias("t")))), lambda x: x["t"]),
            "\n",
        ).alias(out)
    )


def preview(df: DataFrame, text_col: str = "text", out: str = "preview", max_chars: int = PREVIEW_CHARS) -> DataFrame:
    """First ``max_chars`` characters plus a truncation mark; null -> '';
    empty -> the blank marker."""
    t = F.col(text_col)
    cut = F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(TRUNCATED_MARK))).otherwise(t)
    return df.withColumn(out, F.when(t.isNull(), F.lit("")).when(t == "", F.lit(BLANK_MARK)).otherwise(cut))


def line_count(df: DataFrame, text_col: str = "text", out: str = "line_count",
               capped_out: str = "line_count_capped", cap: int | None = None) -> DataFrame:
    """Viewer count = newlines + 1 (empty -> 1); capped count = lines as
    read from a file (a trailing newline adds none, empty -> 0), at most
    ``cap`` where one is given (the viewer's is ``LINE_COUNT_CAP``)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    nl = F.length(t) - F.length(F.regexp_replace(t, "\n", ""))
    viewer = F.when(t == "", F.lit(1)).otherwise(nl + 1)
    read = F.when(t == "", F.lit(0)).otherwise(nl + F.when(t.endswith("\n"), 0).otherwise(1))
    return df.withColumn(out, viewer.cast("int")).withColumn(capped_out, (read if cap is None else F.least(read, F.lit(cap))).cast("int"))
