"""Operator 4: repeated passages, found by winnowing over line hashes.

A passage is a run of lines with ``LEAST_WORDS`` words or more. A line is deleted if it lies in a
passage that also stands earlier in the corpus: in a document that comes before (by id, null
first, then by a hash of the text), or further up in its own.

1. Lines with a word are hashed, without the white space around them. From every line a window
   runs down, and from every line a window runs up, to the nearest line at which it has
   ``LEAST_WORDS`` words. Each passage contains such windows, and they cover it.
2. Winnowing: a window's smallest line hash is its fingerprint. Equal windows have equal
   fingerprints, so a window whose fingerprint stands at one position of the corpus only
   isn't repeated. What is left is mostly repeated.
3. The remaining windows are joined with the first position of the same lines. All others are
   matches. Matches that touch or overlap grow together, up and down, to runs.
4. The lines of the runs go; blank lines between them, too.

Only single positions meet: a passage of a million documents gives a million rows that find the
first one, never pairs. Rows that are equal in id and text are one document, and lose the same
lines. Null texts stay null, and a text that loses all its lines is empty; no row goes.
Where lines go, a column ``n_chars`` is set anew. Empty tables give empty tables. Other columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tractlake.llm.base import WORD, Query, materialize, table

LEAST_WORDS = 50
KEY = ["__id", "__text"]
#: Windows are equal if both hashes of their lines are, 128 bits; the second one starts from this.
SAME = ["all", "second"]
SECOND = 7


def _key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [
        F.col(doc_id).alias("__id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__text"),
    ]


def windows(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(document, first, last, fingerprint, its line, two hashes of all lines) of every window."""
    bare = F.lit(" \t\x0b\f\r")
    parts = F.transform(
        F.split(F.col("text"), "\n"),
        lambda line, at: F.struct(
            at.alias("pos"),
            F.xxhash64(F.btrim(line, bare)).alias("hash"),
            F.xxhash64(F.lit(SECOND), F.btrim(line, bare)).alias("second"),
            F.regexp_count(line, F.lit(WORD)).alias("words"),
        ),
    )
    lines = (
        docs.filter("text IS NOT NULL")
        .select(*_key(), F.filter(parts, lambda x: x["words"] > 0).alias("lines"))
        .groupBy(*KEY)
        .agg(F.first("lines").alias("lines"))
        .select(*KEY, F.explode("lines").alias("line"))
        .select(*KEY, "line.*")
    )
    whole = Window.partitionBy(*KEY)
    above = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.sum("words").over(above)).withColumn(
        "start", F.col("end") - F.col("words")
    )
    down = whole.orderBy("start").rangeBetween(0, least - 1)
    up = whole.orderBy("end").rangeBetween(-(least - 1), 0)

    def values(frame) -> Column:
        return F.struct(
            F.min("pos").over(frame).alias("first"),
            F.max("pos").over(frame).alias("last"),
            F.min(F.struct("hash", "pos")).over(frame).alias("print"),
            F.xxhash64(F.collect_list("hash").over(frame), F.sum("words").over(frame)).alias("all"),
            F.xxhash64(F.lit(SECOND), F.collect_list("second").over(frame)).alias("second"),
        )

    each = ends.select(
        *KEY,
        F.when(F.sum("words").over(whole) - F.col("start") >= least, values(down)).alias("down"),
        F.when(F.col("end") >= least, values(up)).alias("up"),
    )
    both = F.array_distinct(F.array_compact(F.array("down", "up")))
    return each.select(*KEY, F.explode(both).alias("w")).select(
        *KEY,
        F.col("w.first").alias("first"),
        F.col("w.last").alias("last"),
        F.col("w.print.hash").alias("print"),
        F.col("w.print.pos").alias("at"),
        F.col("w.all").alias("all"),
        F.col("w.second").alias("second"),
    )


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(document, first line, last line): what stands earlier as well; lines count from 0."""
    found = materialize(windows(docs, least), "windows")
    prints = found.select(*KEY, "print", "at").distinct().groupBy("print").count()
    often = materialize(prints.filter("count > 1").select("print"), "fingerprints")
    likely = materialize(found.join(often, "print", "left_semi").distinct(), "likely")
    place = F.struct(*KEY, "first")
    earliest = likely.groupBy(*SAME).agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
    earliest = materialize(earliest.filter("n > 1").select(*SAME, "earliest"), "earliest")
    matches = likely.join(earliest, SAME).filter(place > F.col("earliest"))
    before = Window.partitionBy(*KEY).orderBy("first", "last")
    reached = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    is_new = F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int")
    return (
        matches.select(*KEY, "first", "last", is_new.alias("new"))
        .withColumn("run", F.sum("new").over(before))
        .groupBy(*KEY, "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("run")
    )


def drop_repeated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines of repeated runs."""
    runs = repeated_runs(docs, least)
    spans = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__runs"))
    spans = materialize(spans, "runs").withColumnsRenamed({"__id": "__run_id", "__text": "__run_text"})
    # Runs have no bound but the corpus, so they are merged at every size, never broadcast.
    spans = spans.hint("merge")
    own = docs.columns
    keyed = docs.select(F.struct(*[F.col(c) for c in own]).alias("__row"))
    keyed = keyed.select("__row", *_key("__row.doc_id", "__row.text"))
    same = F.col("__id").eqNullSafe(F.col("__run_id")) & (F.col("__text") == F.col("__run_text"))
    joined = keyed.join(spans, same, "left").select(
        "__row", "__runs", F.split(F.col("__row.text"), "\n").alias("__lines")
    )
    # What is kept: from the line after a run to the line before the next one.
    one = F.array(F.lit(0))
    starts = F.concat(one, F.transform("__runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("__runs", lambda r: r["first"]), F.array(F.size("__lines")))
    parts = F.zip_with(
        starts, ends, lambda a, b: F.slice(F.col("__lines"), a + 1, F.greatest(b - a, F.lit(0)))
    )
    text = F.array_join(F.flatten(parts), "\n")
    cut = joined.select("__row", F.when(F.col("__runs").isNotNull(), text).alias("__cut"))
    columns = []
    for f in docs.schema:
        value = F.col(f"__row.`{f.name}`")
        if f.name == "text":
            value = F.coalesce("__cut", value)
        elif f.name == "n_chars":
            value = F.when(F.col("__cut").isNotNull(), F.char_length("__cut").cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    return cut.select(columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dropped_lines, text_md5) per document: what is deleted, and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.size(F.split(F.coalesce("__old", F.lit("")), "\n"))
    left = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    changed = ~F.col("text").eqNullSafe(F.col("__old"))
    return drop_repeated(docs.withColumn("__old", F.col("text"))).select(
        "doc_id",
        F.when(changed, before - left).otherwise(F.lit(0)).cast("long").alias("dropped_lines"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents)
), kept AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line, words,
         sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS word_end,
         sum(words) OVER (PARTITION BY doc_id) AS total
  FROM lines WHERE words > 0
), ends AS (SELECT *, word_end - words AS word_start FROM kept),
windows AS (
  SELECT doc_id, min(pos) OVER down AS first, max(pos) OVER down AS last, list(line) OVER down AS content,
         total - word_start >= 50 AS full_size
  FROM ends WINDOW down AS (PARTITION BY doc_id ORDER BY word_start
                            RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER up, max(pos) OVER up, list(line) OVER up, word_end >= 50
  FROM ends WINDOW up AS (PARTITION BY doc_id ORDER BY word_end
                          RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), matches AS (
  SELECT doc_id, first, last FROM (
    SELECT doc_id, first, last,
           row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS place
    FROM windows WHERE full_size)
  WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM matches
), rest AS (
  SELECT l.doc_id, count(g.pos) AS dropped_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
  GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(r.dropped_lines, 0) AS BIGINT) AS dropped_lines,
       md5(coalesce(r.text, d.text, '')) AS text_md5
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""

QUERIES = [Query("op4_line_dedup", op4_line_dedup, OP4_SQL)]
