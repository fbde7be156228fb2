"""Importance resampling towards a target text by hashed n-grams; DataFrame functions only.

Runs of one to three words are features, hashed into buckets by CRC-32. The log ratio of a bucket's share in the target
and in the corpus, smoothed by one, is its gain; a document weighs the sum of the gains of its features. Adding Gumbel
noise to the weights and taking the highest draws documents without replacement, each with a chance that grows with its
importance.

The words of a long text are cut into pieces that overlap by two words, so no row holds more than PIECE words' features.
Both tables of counts have a row for each bucket. Ranks come from one distributed sort: each row's place in its
partition plus the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import stored

BUCKETS = 10000
#: Words of a piece, whose features are made in one row.
PIECE = 4096
GRAMS = 3
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
SEED = "42"

#: Runs of letters, digits and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    # lower() folds letters beyond ASCII too, so words that have any take the slower way
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def _features(rows: DataFrame) -> DataFrame:
    """rows with `words` replaced by `bucket`, a row for each feature, repeats included; rows without words keep one, null."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE))
    pieces = rows.withColumn("words", F.explode(F.transform(starts, lambda at: F.slice("words", at + 1, PIECE + GRAMS - 1))))
    # the words that follow the last piece's end are null, and so is a feature that would pass it
    shifted = [F.slice("words", n + 1, PIECE).alias(f"w{n}") for n in range(GRAMS)]
    each = pieces.withColumn("at", F.explode_outer(F.arrays_zip(*shifted))).drop("words")
    grams = [F.col("at.w0"), F.concat("at.w0", F.lit(" "), "at.w1"), F.concat("at.w0", F.lit(" "), "at.w1", F.lit(" "), "at.w2")]
    hashed = [F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int") for g in grams]
    return each.select(*[n for n in each.columns if n != "at"], F.explode(F.array(*hashed)).alias("bucket"))


def _counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts."""
    return _features(texts.select(words(F.col("text").cast("string")).alias("words"))).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for the buckets of docs: floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))).

    s and t are the features of a bucket in docs and in target, S and T those of all buckets; null texts have none.
    """
    both = _counts(docs).withColumnRenamed("n", "s").join(_counts(target).withColumnRenamed("n", "t"), "bucket", "full")
    both = stored(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    s, t = (n or 0 for n in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(s + BUCKETS)) / ((F.col("s") + 1).cast("double") * F.lit(float(t + BUCKETS)))
    return both.filter("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, row) for every row of docs: weight is the sum of its features' gains.

    table is that of gains(), at most BUCKETS rows. row tells repeated rows apart.
    """
    rows = docs.select("doc_id", words(F.col("text").cast("string")).alias("words"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    n = F.col("n_words")
    made = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    known = _features(rows).join(F.broadcast(table), "bucket", "left")
    summed = known.groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.select("doc_id", "n_words", made.alias("n_features"), "weight", "row")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their rank (from 1) in the given order: one distributed sort, and the rows of the partitions before."""
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)  # the id is made of the partition and the row in it
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + inside + 1).drop("place", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is null for rows that are not drawn.

    Of the rows with LEAST_WORDS words or more, percent of a hundred are drawn, the highest scores first, ties to the
    smaller doc_id. score is the weight plus Gumbel noise in thousandths, a function of the doc_id alone.

    A null or wordless text has no features and weight 0. A null id takes the noise of an empty one and loses its ties.
    Repeated rows are drawn each for itself. An empty table gives no rows; an empty target has a count of 0 in each
    bucket. Columns other than doc_id and text are ignored.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    digest = F.sha2(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    rows = stored(weighed(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise), "weighed")
    may = rows.filter(F.col("n_words") >= LEAST_WORDS)
    take = may.count() * percent // 100
    in_order = ranked(may, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row"))
    drawn_or_not = in_order.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = rows.filter(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return drawn_or_not.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL for resample(documents, benchmark): CRC-32 by its table of 256 remainders, words and sums as above.
ORACLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS remainders),
texts AS (SELECT 's' AS side, doc_id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 't', NULL, row_number() OVER (), text FROM benchmark),
split AS (
  SELECT side, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
grams AS (
  SELECT side, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS gram FROM split),
counted AS (SELECT side, row, gram, count(*) AS n FROM grams GROUP BY side, row, gram),
octets AS (
  SELECT gram, list_transform(range(0, len(h), 2), lambda i: (instr('0123456789ABCDEF', h[i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 2]) - 1) AS bytes
  FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted))),
hashed AS (SELECT gram, xor(list_reduce(bytes, lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM octets, crc),
shares AS (SELECT bucket, sum(n) FILTER (WHERE side = 's') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM counted JOIN hashed USING (gram) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM shares) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM shares) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM shares WHERE s > 0),
sums AS (SELECT row, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (gram) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT doc_id, row, len(words) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN sums USING (row) WHERE side = 's'),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE n >= 20)
SELECT doc_id, n + greatest(n - 1, 0) + greatest(n - 2, 0) AS n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM placed) * 5 // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (row)
"""
