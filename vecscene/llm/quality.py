"""Quality rules in DataFrame functions only.

Base figures come from arrays inside each row.  The cross-document rule hashes normalised lines, counts the distinct
documents of each host that hold a line (equal texts are one document, so exact copies do not make their own lines common),
takes out lines above a limit, and rejects documents that lose most of their text that way.  The limit is a count: a share
of the host's documents would let a host that holds a third of all rows keep any line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: A line goes if more distinct documents of its host hold it.
MAX_DOCS = 20
#: A document is depleted if less than this share of the characters of its lines is left.
MIN_LEFT = 0.3
#: Words of a window, and the base limits.
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30

_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def figures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, host, same (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("split", F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)))
    n = F.size("words")
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("same"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("split") - F.size(F.array_distinct("split"))).cast("long").alias("n_dup_lines"),
        F.transform("split", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.length(x).cast("long").alias("n"))).alias("lines"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"),
    )
    # windows found twice: neighbours in the order of their hashes
    found = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("found", found).drop("windows")
    at = lambda j: F.get("found", j)["h"]
    twice = F.filter("found", lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False)))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("found")
    covered = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop("places")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """A row for each input row: the figures, n_removed_chars, base_failed, kept.

    Null and empty texts have no words and fail; a null source is the host of the empty one; a null doc_id stays null.
    Repeated rows are judged one by one and count as one document of their host.  Texts may have any length; an empty table
    gives no rows; other columns are not looked at.
    """
    base = materialize(figures(docs).withColumn("rid", F.monotonically_increasing_id()))
    lines = base.select("rid", "host", "same", F.explode("lines").alias("l")).select("rid", "host", "same", "l.line", "l.n")
    seen = lines.select("host", "line", "same").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    common = materialize(seen.where(F.col("n_docs") > max_docs).select("host", "line"))  # written, so that the join's hot lines can be split
    removed = lines.join(common, ["host", "line"]).groupBy("rid").agg(F.sum("n").alias("n_removed_chars"))
    out = base.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("long"), lambda t, x: t + x["n"])).drop("lines").join(removed, "rid", "left").withColumn("n_removed_chars", F.coalesce("n_removed_chars", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = (F.col("line_chars") - F.col("n_removed_chars")) < min_left * F.col("line_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_chars"]


def quality_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select(*RESULT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that judge keeps, all their columns unchanged.  Rows of one doc_id, text and source have one verdict."""
    good = judge(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), F.col("host").alias("_host")).distinct()
    same, host = F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.coalesce(docs["source"], F.lit(""))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]) & (same == good["_same"]) & (host == good["_host"]), "left_semi")
