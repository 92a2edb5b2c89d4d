"""Quality rules: repetition and length rules in the document, and line frequency across documents.

DataFrame functions only. The text is read once: a first pass reduces each document to its
figures and to (hash, words) of its normalised lines, and all that follows works on those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_kept, words_column

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """A line goes if so many documents of the host have it: more than share_percent of the host's, but at least least_documents and at most most_documents.

    A document is rejected if less than keep_percent of its words stand on the lines that stay.
    """

    least_documents: int = 20
    share_percent: float = 2.0
    most_documents: int = 10_000
    keep_percent: int = 20


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space collapsed: what makes two lines the same boilerplate."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"\s+", " "))


def host_key(host_col: str) -> Column:
    """A host as text; null is a host of its own."""
    return F.concat(F.lit("h"), F.coalesce(F.col(host_col).cast("string"), F.lit("")))


def document_figures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document: its figures and lines. Null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), host_key(host_col).alias("host"), F.col(text_col).alias("text"))
    df = df.select("doc_id", "host", text.alias("text"), words_column(F.col("text")).alias("w"))
    # Hashes of all windows; only documents in which one occurs twice go on to the sort.
    df = df.select(
        "*",
        F.size("w").alias("n"),
        F.when(F.size("w") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).alias("win"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_column(x)).alias("words"))).alias("lines"),
    )
    equal = lambda x, j: (F.get(F.col("s"), j)["h"] == x["h"])
    df = df.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", lambda x, j: F.coalesce(equal(x, j - 1), F.lit(False)) | F.coalesce(equal(x, j + 1), F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn("row_id", F.monotonically_increasing_id()).drop("s", "at")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> tuple[DataFrame, DataFrame]:
    """quality_rules() with text_hash, the xxhash64 of the text ("" for null), which tells rows with the same id apart; and the lines above the limits as (host, line hash)."""
    rows = materialize(document_figures(docs, id_col, text_col, host_col), "quality-rows")
    lines = rows.select("row_id", "host", F.explode("lines").alias("l")).select("row_id", "host", "l.line", "l.words")
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    # A document counts once for a line, however often it has it.
    once = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    seen = once.groupBy("host", "line").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") > limits.least_documents)
    above = (F.col("in_docs") * 100 > F.col("docs") * F.lit(limits.share_percent)) | (F.col("in_docs") > limits.most_documents)
    frequent = materialize(seen.join(hosts, "host").where(above).select("host", "line"), "quality-lines")
    removed = lines.join(frequent, ["host", "line"]).groupBy("row_id").agg(F.sum("words").alias("removed_words"))
    out = rows.drop("lines", "host").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * limits.keep_percent
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "text_hash"), frequent


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Judge every document; one row per row of docs.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words
    (on lines above the limit), base_failed, kept. Frequency counts documents, copies too. Null
    text is an empty text and fails the base rules; a null host is a host of its own; null and
    repeated ids are judged row by row; a text of any length is judged whole; extra columns are
    ignored; an empty table gives an empty result.
    """
    return judge(docs, id_col=id_col, text_col=text_col, host_col=host_col, limits=limits)[0].drop("text_hash")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The rows of docs that quality_rules() keeps, their texts without the lines above the limits, and removed_lines, how many those were.

    What stays of a text is byte for byte as it was, blank lines too.
    """
    judged, frequent = judge(docs, id_col=id_col, text_col=text_col, host_col=host_col, limits=limits)
    rest = rows_kept(docs, judged.select("doc_id", "text_hash", "kept"), id_col, text_col)
    # Few lines of a host can be in more than a set share of its documents, so each host's are one short list.
    listed = materialize(frequent.groupBy(F.col("host").alias("bad host")).agg(F.collect_set("line").alias("bad lines")), "quality-host-lines")
    rest = rest.join(listed, host_key(host_col) == listed["bad host"], "left").withColumn("all lines", F.when(F.col("bad lines").isNotNull(), F.split(text_col, "\n", -1)))
    rest = rest.withColumn("good lines", F.filter("all lines", lambda x: ~F.array_contains("bad lines", F.xxhash64(normalised(x)))))
    text = F.when(F.col("all lines").isNull(), F.col(text_col)).otherwise(F.array_join("good lines", "\n"))
    return rest.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), F.coalesce(F.size("all lines") - F.size("good lines"), F.lit(0)).alias("removed_lines"))
