"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What is trimmed from a line's ends.
BLANK = " \t\r"
#: A line must end with a sentence mark, before closing quotes or brackets.
ENDS = "[.!?…][\"'”’»)\\]]*\\z"
#: Menus: two or more separators. Boilerplate: licences, rights, cookies, scripts, sign-up lines.
SEPARATOR = "[|›»>•·]"
NAVIGATION = f"{SEPARATOR}[^\n]*{SEPARATOR}"
PHRASES = (
    "all rights reserved", "licensed under", "creative commons", "cc by", "copyright", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "click here",
    "read more", "sign in", "sign up", "log in", "subscribe", "share this", "share on", "lorem ipsum",
)
#: Punctuation: two marks in a row other than dots and quotes, at most in this share of the line's words.
CLUTTER, MOST_CLUTTER = "[#$%&*!?=+~^_<>]{2,}", 0.1
#: Of a text's characters, line ends aside, this share at most may go.
MOST_LOST = 0.5


def _boilerplate(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in PHRASES])


#: For each rule that few texts need to be asked about: what a text must have in it for that, and the rule for a line.
RULES = {
    "menus": (lambda text, low: text.rlike(SEPARATOR), lambda x: ~x.rlike(NAVIGATION)),
    "marks": (lambda text, low: text.rlike(CLUTTER), lambda x: F.regexp_count(x, F.lit(CLUTTER)) <= F.size(F.split(x, " ")) * MOST_CLUTTER),
    "notices": (lambda text, low: _boilerplate(low), lambda x: ~_boilerplate(F.lower(x))),
}


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """(doc_id, clean_text, n_lines, n_kept, lost, keep), a row for each of docs.

    Lines are cut at line feeds and trimmed of spaces, tabs and carriage returns, so that texts with either kind of
    line end come out alike; other white space, such as a no-break space, counts as text. lost is the share of the
    trimmed lines' characters that lie in lines that fail. keep is whether lost is at most most_lost and some line is
    left. Texts that are null, empty or blank have no line left: clean_text is empty, lost is 1 and they are rejected.
    Repeated rows and null doc_ids keep their rows. Texts are used whole; columns other than doc_id and text are left
    out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.withColumns({k: there(F.col("text"), F.col("low")) for k, (there, _) in RULES.items()})
    parts, odd = F.split("text", "\n"), F.contains(F.col("text"), F.lit("\t")) | F.contains(F.col("text"), F.lit("\r"))
    trimmed = F.when(odd, F.transform(parts, lambda x: F.trim(x, F.lit(BLANK)))).otherwise(F.transform(parts, lambda x: F.trim(x)))  # trimming spaces alone is much faster
    rows = rows.select("doc_id", *RULES, F.filter(trimmed, lambda x: x != "").alias("lines"))
    rows = rows.withColumn("kept", F.filter("lines", lambda x: x.rlike(ENDS)))
    for k, (_, rule) in RULES.items():
        rows = rows.withColumn("kept", F.when(F.col(k), F.filter("kept", rule)).otherwise(F.col("kept")))
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    rows = rows.select("doc_id", "lines", "kept", size("lines").alias("total"), size("kept").alias("left"))
    lost = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(1 - F.col("left") / F.col("total"))
    found = F.struct(F.array_join("kept", "\n").alias("clean_text"), F.size("lines").cast("bigint").alias("n_lines"), F.size("kept").cast("bigint").alias("n_kept"), F.round(lost, 6).alias("lost"))
    # one row of one struct: a condition on it isn't pushed below, where everything would be computed again to ask it
    done = rows.select("doc_id", F.explode_outer(F.array(found)).alias("found")).select("doc_id", "found.*")
    return done.withColumn("keep", (F.col("lost") <= most_lost) & (F.col("n_kept") > 0))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, cleaned."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("keep")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM documents
), k AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: regexp_matches(x, {_sql(ENDS)}) AND NOT regexp_matches(x, {_sql(NAVIGATION)})
    AND NOT regexp_matches(lower(x), {_sql('|'.join(PHRASES))}) AND len(regexp_extract_all(x, {_sql(CLUTTER)})) <= len(string_split(x, ' ')) * {MOST_CLUTTER}) AS kept FROM l
), s AS (
  SELECT doc_id, array_to_string(kept, chr(10)) AS clean_text, len(lines)::BIGINT AS n_lines, len(kept)::BIGINT AS n_kept,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS a, coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS b FROM k
), r AS (
  SELECT doc_id, clean_text, n_lines, n_kept, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE round(1 - b::DOUBLE / a, 6) END AS lost FROM s
)
SELECT *, lost <= {MOST_LOST} AND n_kept > 0 AS keep FROM r WHERE lost <= {MOST_LOST} AND n_kept > 0
"""
