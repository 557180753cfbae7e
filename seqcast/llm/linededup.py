"""Repeated runs of lines, by a suffix array over line numbers that is sorted by prefix doubling.

Every line with content is a number, equal for equal lines; a document is its sequence of numbers, and a suffix begins
at each line. Ranks by the first line double to ranks by the first two, four, ... lines: the rank of a suffix and of the
one ``h`` lines on make the rank by ``2h`` lines. Sorting stops at ``min_lines``: the intervals of the suffix array whose
longest common prefix is at least that long are then just the groups of equal rank. The first suffix of an interval is
the first copy of its run; lines that any other suffix of it covers are deleted. What follows each other in a document
makes its maximal repeated runs.

With ``min_words``, a run of fewer lines counts too if it holds that many words: ranks then grow by one line a round, and
of each round the intervals whose lines hold enough words are taken as well. Words lie between ASCII white space.

All of it is DataFrame functions. Ranks come from a range partitioning of *distinct* keys with their counts, and are the
places in that order (with gaps), so that no window or sort holds a hot line: a line that a third of all documents have
is one key. Suffixes whose rank is theirs alone cannot begin a repeated run and leave after each round, which leaves a
small part of the lines of a clean corpus. Joins bring ranks and first copies back from tables with one row per key, which
are counted: the rows of a hot key are dealt out by as many salts as its count asks for.

Defined cases. Null text has no lines and stays null. Blank lines are no lines; a text that loses lines loses its blank
ones too, other texts stay as they are. "Earlier" is by id, then by line. Rows with one id are told apart by their text;
equal rows are one document. Rows without an id are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, prepare, written
from seqcast.operators.skew import join_on_key

#: Lines of the shortest run that counts as repeated.
MIN_LINES = 3
#: Words from which a shorter run counts in a corpus.
MIN_WORDS = 50
_CONTENT = r"[^\x20\x09-\x0D]"
_WORD = _CONTENT + "+"


def _lines(text: Column) -> Column:
    """The lines with content, in order."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_CONTENT))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """The rows, which are distinct in ``by``, each with its place in their order."""
    return written(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "ranks")


def _with_ranks(rows: DataFrame, *by: str) -> DataFrame:
    """The rows that share their values of ``by`` with others, with the place of these."""
    ranks = _ranked(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), *by)
    return join_on_key(rows, ranks.drop("n"), by, counts=ranks.select(*by, "n"), spread_by=["doc", "mark", "k"])


def _later(suffixes: DataFrame, lines: int) -> DataFrame:
    """The lines that suffixes beyond the first of their rank cover."""
    place = F.struct("doc", "mark", "k")
    first = written(suffixes.groupBy("rank").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    later = join_on_key(suffixes, first.select("rank", "first"), ["rank"], counts=first.select("rank", "n"), spread_by=["doc", "mark", "k"])
    later = later.where(place > F.col("first"))
    return later.select("doc", "mark", F.explode(F.sequence("k", F.col("k") + (lines - 1))).alias("k"))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc, mark, runs, removed): for each document with later copies, its maximal runs of them as structs of the first
    and the last line (from 0, lines with content only), in order, and how many lines they hold. ``mark`` is the 64-bit
    hash of the text. A run has ``min_lines`` lines or, if given, ``min_words`` words."""
    prepare(docs.sparkSession)
    whole = F.col(f"`{text}`").cast("string")
    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("mark"), F.posexplode(_lines(whole)).alias("k", "line"))
    # Words of the first line, and of all lines that the rank stands for.
    own = [] if min_words is None else [F.regexp_count("line", F.lit(_WORD)).alias("own")]
    counted = [] if min_words is None else ["own", "total"]
    lines = written(rows.select("doc", "mark", "k", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *own).distinct(), "lines")
    met = _with_ranks(lines, "h1", "h2")
    if counted:
        met = met.withColumn("total", F.col("own"))
    suffixes = written(met.select("doc", "mark", "k", F.col("place").alias("rank"), *counted), "suffixes")
    known, short = 1, []
    while known < min_lines:
        if counted:
            short.append(_later(suffixes.where(F.col("total") >= min_words), known))
        step = 1 if counted else min(known, min_lines - known)
        on = suffixes.select("doc", "mark", (F.col("k") - step).alias("k"), F.col("rank").alias("then"), *(F.col(c).alias("rest") for c in counted[1:]))
        pairs = suffixes.join(on, ["doc", "mark", "k"])
        if counted:
            pairs = pairs.withColumn("total", F.col("own") + F.col("rest")).drop("rest")
        pairs = written(pairs, "pairs")
        suffixes = written(_with_ranks(pairs, "rank", "then").select("doc", "mark", "k", F.col("place").alias("rank"), *counted), "suffixes")
        known += step
    gone = _later(suffixes, min_lines)
    for found in short:
        gone = gone.union(found)
    gone = gone.distinct()
    one = Window.partitionBy("doc", "mark").orderBy("k")
    runs = gone.withColumn("island", F.col("k") - F.row_number().over(one)).groupBy("doc", "mark", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return runs.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum(F.col("last") - F.col("first") + 1).alias("removed"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """The documents with a struct column ``lines`` (underscores follow if the name is taken) as their last: ``n_lines``,
    ``n_removed``, the ``runs`` that go (null: none) and ``kept_text``.

    Write the result before a Python function is applied to it: Spark 4.1 does not find one above these nested lambdas."""
    name = fresh(docs, "lines")
    doc, mark, found, removed = (fresh(docs, f"{name}_{c}") for c in ("doc", "mark", "runs", "removed"))
    runs = written(repeated_runs(docs, key, text, min_lines, min_words), "runs")
    runs = runs.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("runs").alias(found), F.col("removed").alias(removed))
    whole, gone = docs[f"`{text}`"].cast("string"), F.col(found)
    met = docs.join(runs.hint("shuffle_hash"), (docs[f"`{key}`"] == F.col(doc)) & (F.xxhash64(whole) == F.col(mark)), "left")
    stay = F.filter(_lines(whole), lambda _, k: ~F.exists(gone, lambda r: (k >= r["first"]) & (k <= r["last"])))
    judged = F.struct(
        F.coalesce(F.size(_lines(whole)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col(removed), F.lit(0)).cast("long").alias("n_removed"),
        gone.alias("runs"),
        F.when(gone.isNull(), whole).otherwise(F.array_join(stay, "\n")).alias("kept_text"),
    )
    return met.select(*(docs[f"`{c}`"] for c in docs.columns), judged.alias(name))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """The documents, with their columns, less the lines of later copies. One that loses all of its lines goes; a count
    of characters (``n_chars``) is brought up to date."""
    judged = line_dedup(docs, key, text, min_lines, min_words)
    verdict = F.col(f"`{judged.columns[-1]}`")
    changed = verdict["n_removed"] > 0
    values = {c: F.col(f"`{c}`") for c in docs.columns}
    values[text] = verdict["kept_text"].alias(text)
    if "n_chars" in values:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(changed, F.length(verdict["kept_text"]).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return judged.where(~changed | (verdict["n_removed"] < verdict["n_lines"])).select(*values.values())
