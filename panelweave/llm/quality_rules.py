"""Line-first cleaning with built-in expressions only: every line is judged, failing lines go, and a document that loses
too much of its text goes as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import GAP, GAP_CHARS, columns, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|·•›»"
SENTENCE_ENDS = r"[.!?…。！？]"
# fixed: phrases of page furniture, matched in short lines only
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|subscribe now|sign up|"
    r"log in|click here|read more|share this|back to top|enable javascript|copyright \d{4}|licensed under|spdx-license)"
)
BOILERPLATE_WORDS = 30
LEAST_WORDS = 50
REPEATED_PERCENT = 50
LOST_PERCENT = 50
LINE_WORDS = 5


def count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once: the argument of a transform over one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more; windows are compared by 64-bit hash."""
    n = F.size(words)
    hashes = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(n - 2, F.lit(0)),
    )

    def twice(ordered: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(ordered, j)["h"] == e["h"], F.lit(False))
        return F.filter(ordered, lambda e, i: same(e, i - 1) | same(e, i + 1))

    def covered(starts: Column) -> Column:
        span = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
        return F.aggregate(span, F.lit(0), lambda a, x: a + x)

    # only texts with an equal pair of windows are sorted by place
    return F.when(n < 3, 0).otherwise(
        bound(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                bound(
                    F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                    lambda o: bound(F.sort_array(F.transform(twice(o), lambda e: e["i"])), covered),
                )
            ),
        )
    )


def line_fails(line: Column) -> Column:
    """Punctuation, symbols, shouting, navigation or boilerplate."""
    return bound(F.size(words_of(line)), lambda n: _fails(line, n))


def _fails(line: Column, n: Column) -> Column:
    shout = count_of(line, "!") >= n
    nav = (count_of(line, SEPARATORS) >= 3) & (count_of(line, SEPARATORS) * 4 >= n)
    symbols = count_of(line, SYMBOLS) * 2 >= n
    phrase = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    unpunctuated = (n >= LINE_WORDS) & ~line.rlike(SENTENCE_ENDS)
    return shout | nav | symbols | phrase | unpunctuated


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one column ``q`` (struct) with the counts, the cleaned text and the verdict of each row.

    Null text counts as empty: no words, so it fails the base rules. A line that repeats an earlier one is removed
    like a failing line. Blank lines are not counted; they fail no rule and stay between kept lines. Rows are judged one by one: ties and repeated rows get
    the same verdict; an empty table gives an empty table."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.withColumn("q", F.struct(t.alias("t"), words_of(t).alias("w")))
    # no line holds a line feed: it marks a blank line, and its number keeps blank lines apart from each other
    blank = lambda x: F.char_length(F.translate(x, GAP_CHARS, "")) == 0
    marked = F.transform(
        F.split(F.col("q.t"), "\n"), lambda x, i: F.when(blank(x), F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), x)).otherwise(x)
    )
    is_line = lambda x: ~x.startswith("\n")
    with_lines = base.withColumn("q", F.struct("q.*", marked.alias("all")))
    with_lines = with_lines.withColumn(
        "q", F.struct("q.*", F.filter("q.all", is_line).alias("all_lines"), F.array_distinct("q.all").alias("kept"))
    )
    with_lines = with_lines.withColumn(
        "q", F.struct("q.*", F.filter("q.kept", lambda x: ~is_line(x) | ~line_fails(x)).alias("good"))
    )
    def inner(flags: Column) -> Column:
        """From the first line that is kept to the last, with the blank lines between."""
        first, behind = F.array_position(flags, True), F.array_position(F.reverse(flags), True)
        span = F.slice("q.good", first.cast("int"), (F.size(flags) + 2 - behind - first).cast("int"))
        return F.when(first > 0, F.array_join(F.transform(span, lambda x: F.substring_index(x, "\n", -1)), "\n")).otherwise("")

    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.char_length(x))
    counted = with_lines.withColumn(
        "q",
        F.struct(
            F.size("q.w").cast("bigint").alias("n_words"),
            F.char_length(F.translate("q.t", GAP_CHARS, "")).cast("bigint").alias("word_chars"),
            count_of(F.col("q.t"), SYMBOLS).cast("bigint").alias("n_symbols"),
            (F.size("q.all") - F.size("q.kept")).cast("bigint").alias("n_dup_lines"),
            bound(F.col("q.w"), repeated_words).cast("bigint").alias("n_repeat_words"),
            total(F.col("q.all_lines")).alias("line_chars"),
            bound(F.transform("q.good", is_line), inner).alias("clean_text"),
            total(F.filter("q.good", is_line)).alias("clean_chars"),
        ),
    )
    failed = (F.col("q.n_words") < LEAST_WORDS) | (100 * F.col("q.n_repeat_words") > REPEATED_PERCENT * F.col("q.n_words"))
    lost = 100 * (F.col("q.line_chars") - F.col("q.clean_chars")) > LOST_PERCENT * F.col("q.line_chars")
    return counted.withColumn("q", F.struct("q.*", failed.alias("base_failed"), (~failed & ~lost).alias("kept")))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, line_chars and clean_chars of every row."""
    return judged(columns(docs, doc_id="bigint", text="string")).select(
        "doc_id",
        *[
            F.col(f"q.{c}").alias(c)
            for c in (
                "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept line_chars clean_chars".split()
            )
        ],
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns untouched, whatever they are called."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = packed.withColumn("text", F.col("row.text"))
    return judged(text).filter("q.kept").select("row.*")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, without the lines that fail or repeat an earlier one, and n_chars (if there) counted
    anew; other columns as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = judged(packed.withColumn("text", F.col("row.text")))
    kept = seen.select("row", F.explode(F.array("q")).alias("q")).filter("q.kept")  # judged once, not once more for the filter
    kind, clean = dict(docs.dtypes), F.col("q.clean_text")
    new = {"text": clean} | ({"n_chars": F.char_length(clean).cast(kind["n_chars"])} if "n_chars" in kind else {})
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


# The same rules for DuckDB. A line keeps its text; hashes are not needed there.
REPORT_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, [x for x in string_split_regex(text, '{GAP}') if x <> ''] AS w,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
win AS (SELECT k, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, sum(least(3, coalesce(nx - i, 3))) AS n FROM
        (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM rep) GROUP BY k),
ln AS (SELECT DISTINCT k, unnest(l) AS x FROM w),
lc AS (SELECT k, x, length(x) AS c, len([y for y in string_split_regex(x, '{GAP}') if y <> '']) AS n,
        length(x) - length(translate(x, '!', '')) AS bang,
        length(x) - length(translate(x, '{SEPARATORS}', '')) AS seps,
        length(x) - length(translate(x, '{SYMBOLS}', '')) AS syms FROM ln),
good AS (SELECT k, count(*) AS n_lines, sum(CASE WHEN bang >= n OR (seps >= 3 AND seps * 4 >= n) OR syms * 2 >= n
          OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(x, '{BOILERPLATE}'))
          OR (n >= {LINE_WORDS} AND NOT regexp_matches(x, '[.!?…。！？]')) THEN 0 ELSE c END) AS clean FROM lc GROUP BY k),
f AS (SELECT t.doc_id, len(w.w) AS n_words, length(translate(t.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
          AS word_chars,
        length(t.text) - length(translate(t.text, '{SYMBOLS}', '')) AS n_symbols,
        len(w.l) - coalesce(good.n_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        coalesce(list_sum([length(x) for x in w.l]), 0) AS line_chars, coalesce(good.clean, 0) AS clean_chars
      FROM t JOIN w USING (k) LEFT JOIN good USING (k) LEFT JOIN cov USING (k)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * (line_chars - clean_chars) > {LOST_PERCENT} * line_chars AS kept,
  CAST(line_chars AS BIGINT) AS line_chars, CAST(clean_chars AS BIGINT) AS clean_chars FROM b
"""
