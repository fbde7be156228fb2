"""Alias lookup, query classes and the search plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.text import normalized
from tramline.operators.shared import cut


#: Characters of the pieces of a text by which it is found inside another.
GRAM = 8
#: An entry of more words is looked up by two of them, not by each set that lacks one.
MOST_WORDS = 16
#: A set of words that so many pairs share is divided into blocks of so many titles and aliases.
PAIRS, SIDE = 1_000_000, 1_000


def _runs(c: Column, size: int) -> Column:
    """The runs of so many characters of a text, or the whole of a shorter one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda n: F.substring(c, n, F.lit(size)))


def _grams(c: Column, *shorter: int) -> Column:
    """The distinct runs of GRAM characters of a text, or the whole of a shorter one, and its runs of the other sizes."""
    return F.filter(F.array_distinct(F.concat(_runs(c, GRAM), *[_runs(c, size) for size in shorter])), lambda g: g != "")


def _words(c: Column) -> Column:
    """The distinct words of a normalized text, sorted."""
    return F.sort_array(F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != ""))


def _word_sets(c: Column) -> Column:
    """(words, lacking, but) of an entry's text: a title with all words of a set but `lacking` names the entry.

    One set has all words. The others lack one each, `but`, of three or more; a title that has it names the entry by all words.
    """
    one = lambda words, lacking, but: F.struct(words.alias("words"), F.lit(lacking).alias("lacking"), but.alias("but"))
    none, words = F.lit(None).cast("string"), _words(c)
    less = F.when(F.size(words) >= 3, F.transform(words, lambda w: one(F.array_remove(words, w), 0, w))).otherwise(F.array())
    return F.when(F.size(words) > MOST_WORDS, F.array(one(words, 1, none))).otherwise(F.concat(F.array(one(words, 0, none)), less))


def _rarest(rows: DataFrame, key: list[str], keys: str, often: DataFrame, n: Column | int) -> DataFrame:
    """(key, k): the n entries of the array `keys` that fewest rows of often (k, count) have."""
    flat = rows.select(*key, F.explode(keys).alias("k"), (n if isinstance(n, Column) else F.lit(n)).alias("n")).join(often, "k", "left")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("count", F.lit(0)), "k"))
    return flat.withColumn("place", place).filter("place <= n").select(*key, "k")


def _sized(c: Column, texts: DataFrame) -> list[int]:
    """The lengths under GRAM that texts have."""
    return sorted(r.n for r in texts.select(F.length(c).alias("n")).filter(F.col("n") < GRAM).distinct().collect())


def _dealt(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The equality join by key, in which no task holds more than some blocks of the pairs of a key."""
    counted = left.groupBy(key).agg(F.count("*").alias("m")).join(right.groupBy(key).agg(F.count("*").alias("n")), key).filter(F.col("m") * F.col("n") > PAIRS)
    hot = F.broadcast(counted.select(key, F.ceil(F.col("m") / SIDE).alias("m"), F.ceil(F.col("n") / SIDE).alias("n")))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(rows: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        drawn = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.coalesce(F.col(of), F.lit(1)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(others), F.lit(1)) - 1))
        return rows.join(hot, key, "left").select(*rows.columns, drawn.alias(own), every.alias(other)).repartition(tasks, key, "i", "j")

    return blocks(left, "i", "m", "j", "n").join(blocks(right, "j", "n", "i", "m"), [key, "i", "j"]).drop("i", "j")


def alias_hits(titles: DataFrame, title: str, aliases: DataFrame) -> DataFrame:
    """(title, alias) of distinct titles that name an alias entry (name, alias).

    Both are normalized. A title names an entry if either text lies in the other, if it has all of the entry's words, or
    all but one of three or more. No loop over the dictionary: entries of the same words, or of the same but one, are one
    set, which waits under its rarest word, and a title asks with all of its own. A title is paired with the aliases of
    its sets at the end, once each, so a set that very many share makes no more rows than the result has. An entry
    also waits under its rarest run of GRAM characters, a title asks with all of its own, and the other way round for titles
    inside entries; each candidate is then checked. Texts without a word name nothing.
    """
    # distinct by a digest, so that conditions on the normalized texts are not tried on every repeat of a title
    once = lambda d, c, *keep: d.groupBy(F.md5(c).alias("digest"), *keep).agg(F.first(c).alias("text")).drop("digest")
    titles_of = cut(once(titles, title).select(F.col("text").alias("title"), normalized(F.col("text")).alias("t")).filter("t <> ''"))
    aliases_of = once(aliases, "name", "alias").select("alias", normalized(F.col("text")).alias("e")).filter("e <> ''").distinct()
    aliases_of = cut(aliases_of.withColumn("several", F.count("*").over(Window.partitionBy("alias")) > 1))
    # many titles and many entries are one text each once normalized, and each pair of texts is checked once
    own, other = (cut(d.select(c).distinct()) for d, c in ((titles_of, "t"), (aliases_of, "e")))
    count = lambda c: other.select(F.explode(c).alias("k")).groupBy("k").count()
    asked = lambda keys: own.select("t", F.explode(keys).alias("k"))

    entries = other.select("e", F.explode(_word_sets(F.col("e"))).alias("set")).select("e", "set.*")
    entries = cut(entries.withColumn("words_id", F.md5(F.concat_ws(" ", F.col("lacking").cast("string"), "words"))))
    sets = entries.groupBy("words_id").agg(F.first("words").alias("words"), F.first("lacking").alias("lacking"))
    by_word = _rarest(sets, ["words_id"], "words", count(_words(F.col("e"))), F.col("lacking") + 1).join(sets, "words_id")
    held = asked(_words(F.col("t"))).join(by_word, "k").filter(F.size(F.array_except("words", _words(F.col("t")))) <= F.col("lacking"))
    held = cut(held.select("t", "words_id").distinct())

    # a text that is shorter than GRAM is a run of its own, so the other side asks with its runs of that size too
    by_gram = _rarest(other.withColumn("grams", _grams(F.col("e"))), ["e"], "grams", count(_grams(F.col("e"))), 1)
    inside = _rarest(own.withColumn("grams", _grams(F.col("t"))), ["t"], "grams", count(_grams(F.col("e"))), 1)
    runs = other.select("e", F.explode(_grams(F.col("e"), *_sized(F.col("t"), own))).alias("k"))
    needed, shared = F.size(_words(F.col("e"))), F.size(F.array_intersect(_words(F.col("t")), _words(F.col("e"))))
    named = (shared == needed) | ((needed >= 2) & (shared >= F.greatest(F.lit(2), needed - 1)))
    found = asked(_grams(F.col("t"), *_sized(F.col("e"), other))).join(by_gram, "k").select("t", "e").filter(F.contains("t", F.col("e")))
    found = found.unionByName(inside.join(runs, "k").select("t", "e").filter(F.contains("e", F.col("t")) & ~F.contains("t", F.col("e"))))
    found = cut(found.filter(~named))

    def pairs(some: DataFrame) -> DataFrame:
        by_set = _dealt(held.join(titles_of, "t").select("words_id", "title", _words(F.col("t")).alias("has")), entries.join(some, "e").select("words_id", "alias", "but"), "words_id")
        by_set = by_set.filter(F.col("but").isNull() | ~F.array_contains("has", F.col("but")))
        return by_set.select("title", "alias").unionByName(found.join(some, "e").join(titles_of, "t").select("title", "alias"))

    # each pair of texts is there once, so only an alias of several texts can meet a title twice
    return pairs(aliases_of.filter("NOT several")).unionByName(pairs(aliases_of.filter("several")).distinct())


def query_class(query: Column) -> Column:
    """acronym, long_latin, short_common or plain."""
    words = F.regexp_extract_all(query, F.lit(r"([A-Za-z][A-Za-z0-9'\-]*)"), 1)
    n, size = F.size(words), F.length(query)
    long_latin = (n >= 4) & (query.contains(":") | (size >= 28) | F.exists(words, lambda w: w.contains("-")))
    few = F.size(F.filter(F.split(query, r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")) <= 2
    return F.when(F.rlike(query, F.lit("^[A-Z]{2,4}$")), "acronym").when(long_latin, "long_latin").when(few | (size <= 14) | ((n <= 2) & (size <= 18)), "short_common").otherwise("plain")


def search_plan(queries: DataFrame, key: str, candidates: str, media: str, year: str) -> DataFrame:
    """(key, step, query, media, year): every distinct query of the array in order, with the year, its neighbours and none.

    An item of unknown media is searched as both.
    """
    kinds = F.when(F.col(media).isin("movie", "tv"), F.array(media)).otherwise(F.array(F.lit("movie"), F.lit("tv")))
    offsets = F.when(F.col(year).isNotNull(), F.array(F.col(year), F.col(year) - 1, F.col(year) + 1, F.lit(None).cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
    steps = F.flatten(F.transform(F.array_distinct(candidates), lambda q: F.flatten(F.transform(kinds, lambda m: F.transform(offsets, lambda y: F.struct(q.alias("query"), m.alias("media"), y.alias("year")))))))
    return queries.select(key, F.posexplode(steps).alias("step", "s")).select(key, "step", "s.query", "s.media", "s.year")


def resolve(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """(key, entry_id, points): the best dictionary entry by exact title, year distance, media and source; first of ties.

    candidates hold key, entry_id, exact, year_gap, media_type, source and the order column.
    """
    near = F.when(F.col("year_gap") == 0, 25).when(F.col("year_gap") == 1, 15).when(F.col("year_gap") == 2, 5).otherwise(0)
    points = F.when(F.col("exact"), 100).otherwise(0) + near + F.when(F.col("media_type") == "tv", 3).otherwise(0) + F.when(F.col("source") == "manual", 1000).otherwise(0)
    best = candidates.withColumn("points", points).groupBy(key).agg(F.max_by(F.struct("entry_id", "points"), F.struct("points", -F.col(order))).alias("b"))
    return best.select(key, "b.entry_id", "b.points")
