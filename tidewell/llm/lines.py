"""Line dedup: repeated runs of lines by distributed prefix doubling.

The documents are sequences of line IDs.  A round of prefix doubling gives each
suffix the rank of its first 2k lines from the ranks of its first k and of the k
that follow; ranks are 128-bit names, as only their equality is used.  Suffixes of
equal rank form a longest-common-prefix interval; a suffix that is alone in its
interval leaves.  In the intervals of ``min_lines`` lines all but the earliest are
later copies; the lines that they cover are maximal repeated runs, and they go.  A
longer common prefix covers no further line, so the ranks double no further.  A line
of ``min_words`` words is a run of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import WORD, durable, table

MIN_LINES = 2
#: A repeated line of so many words goes whatever its neighbours are.
MIN_WORDS = 50
#: Intervals of more than one in so many of all suffixes are broadcast; there are fewer of them than this.
HEAVY = 1000
_AT = ["doc_id", "_t"]


def _name(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit("second"), *parts).alias("_b")]


def _with_shared(ranks: DataFrame, facts: DataFrame) -> DataFrame:
    """Suffixes of the intervals that hold another one, with what ``facts`` says of the interval.

    ``facts`` has one row with its size _n for each interval.  At most HEAVY intervals can
    hold more than one in HEAVY of all suffixes: these are broadcast, so that no task gets
    all suffixes of a common line; the rest meets its facts in a shuffle.
    """
    shared = facts.filter("_n > 1")
    least = F.lit(ranks.count() / HEAVY)
    heavy, light = F.broadcast(shared.filter(F.col("_n") > least)), shared.filter(F.col("_n") <= least)
    common = ranks.join(heavy, ["_a", "_b"])
    return common.unionByName(ranks.join(F.broadcast(heavy.select("_a", "_b")), ["_a", "_b"], "left_anti").join(light, ["_a", "_b"]))


def _repeated(ranks: DataFrame) -> DataFrame:
    """Suffixes whose interval holds another one."""
    return _with_shared(ranks, ranks.groupBy("_a", "_b").agg(F.count("*").alias("_n"))).drop("_n")


def _extend(ranks: DataFrame, by: int) -> DataFrame:
    """Ranks of a longer prefix: of each suffix and of the one ``by`` lines later."""
    later = ranks.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), (F.col("_j") - by).alias("_k"), F.col("_a").alias("_c"), F.col("_b").alias("_e"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")) & (F.col("_j") == F.col("_k"))
    return ranks.join(later, same).select("doc_id", "_t", "_j", *_name("_a", "_b", "_c", "_e"))


def _with_lines(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_t", F.xxhash64("_text")).withColumn("_lines", F.split("_text", "\n", -1))


def _later(ranks: DataFrame) -> DataFrame:
    """Suffixes that are not the earliest of their interval."""
    first = ranks.groupBy("_a", "_b").agg(F.min(F.struct("doc_id", "_t", "_j")).alias("_first"), F.count("*").alias("_n"))
    return _with_shared(ranks, first).filter(~F.struct("doc_id", "_t", "_j").eqNullSafe(F.col("_first")))


def _of_words(line: Column, n: int) -> Column:
    """Whether a line has n words; lines too short for them are not searched."""
    return F.when(F.length(line) >= 2 * n - 1, F.regexp_count(line, F.lit(WORD)) >= n).otherwise(False)


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """For each document with later copies: the indexes _gone of their lines, and _runs."""
    split = _with_lines(docs.select("doc_id", "text"), F.col("text"))
    whole = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.length(F.regexp_replace(s["x"], r"\s+", "")) > 0)
    words = [_of_words(F.col("_line.x"), min_words).alias("_long")] if min_words else []
    lines = split.select("doc_id", "_t", F.posexplode(whole).alias("_j", "_line")).select("doc_id", "_t", F.col("_j").cast("long").alias("_j"), F.col("_line.i").alias("_i"), *_name(F.col("_line.x")), *words)
    lines = durable(lines.distinct(), "line-ranks")
    ranks, length = lines.select("doc_id", "_t", "_j", "_a", "_b"), 1
    while length < min_lines:
        step = min(length, min_lines - length)
        ranks, length = durable(_extend(_repeated(ranks), step), "line-ranks"), length + step
    at = [F.col("doc_id").alias("_d"), F.col("_t").alias("_u")]
    covered = _later(ranks).select(*at, F.explode(F.sequence(F.col("_j"), F.col("_j") + (min_lines - 1))).alias("_k"))
    if min_words:
        single = lines.filter("_long").select("doc_id", "_t", "_j", "_a", "_b")
        covered = covered.unionByName(_later(single).select(*at, F.col("_j").alias("_k")))
    covered = covered.distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")) & (F.col("_j") == F.col("_k"))
    runs = F.size(F.array_except(F.collect_list("_j"), F.transform(F.collect_list("_j"), lambda j: j + 1)))
    return lines.join(covered, same).groupBy(*_AT).agg(F.collect_list("_i").alias("_gone"), runs.cast("long").alias("_runs"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_removed", "n_runs")) -> DataFrame:
    """Every row with later copies of repeated line runs deleted from its text.

    Lines end at newlines; blank lines are not compared and stay.  A run of at least
    ``min_lines`` consecutive lines, or a line of at least ``min_words`` words (None: no
    such rule), stays where it occurs first, in the order of doc_id (null first), text
    hash and line.  Adds n_lines, n_removed and n_runs (long; 0 removed where nothing is)
    under ``names`` to the input's columns, whose text is the kept one (null stays null);
    input columns of these names are replaced, all others come back as they are.  A doc_id
    with several different texts counts as several documents; rows repeated with doc_id and
    text are one document, and each gets its result.  Texts of any length are compared
    whole: a text is one row here, its lines are rows of their own.  An empty table gives
    no rows.
    """
    gone = later_copies(docs, min_lines, min_words).withColumnsRenamed({"doc_id": "_d", "_t": "_u"})
    # columns are numbered inside, so that no name of the input can clash
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    split = _with_lines(inner, at["text"])
    joined = split.join(gone, at["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), at["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    new = [F.size("_lines"), removed, F.coalesce("_runs", F.lit(0))]
    rest = [(kept if c == "text" else x).alias(c) for c, x in at.items() if c.lower() not in {n.lower() for n in names}]
    return joined.select(*rest, *[x.cast("long").alias(n) for x, n in zip(new, names)])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE length(regexp_replace(line, '\s+', '', 'g')) > 0),
w AS (SELECT a.doc_id, a.j, a.line AS x, b.line AS y FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.j = a.j + 1),
r AS (SELECT doc_id, j, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, j) AS n FROM w),
o AS (SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) AS n FROM f WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, j FROM r WHERE n > 1 UNION ALL SELECT doc_id, j + 1 FROM r WHERE n > 1 UNION ALL SELECT doc_id, j FROM o WHERE n > 1)),
g AS (SELECT f.doc_id, f.i, f.j FROM f JOIN c USING (doc_id, j)),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p <> j - 1) AS n_runs
      FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM g) GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_runs, 0) AS n_runs, md5(coalesce(k.kept, '')) AS kept_md5
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
