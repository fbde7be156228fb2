"""Readers: stored tables with missing columns, catalogue pages, dictionary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tramline.functions.text import compact_spaces, rx, strip_html


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table under a wider schema: columns that its files lack are typed nulls."""
    return spark.read.schema(schema).parquet(path)


def listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each table row of a catalogue page that links to a details page.

    details_id, title, category_id, comments, size, date_text, seeds, peers and uploader; numbers that are missing count
    as 0, missing texts are blank, a missing category is null.
    """
    rows = pages.select("*", F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)(<tr\b.*?</tr>)"), 1)).alias("row_html"))
    link = F.regexp_extract("row_html", rx(r'href="[^"]*details[^"]*[?&]id=(\d+)'), 1)
    title = compact_spaces(strip_html(F.regexp_extract("row_html", r'(?is)href="[^"]*details[^"]*"[^>]*>(.*?)</a>', 1)))
    cells = F.regexp_extract_all("row_html", F.lit(r"""(?is)<td[^>]*class=["']s["'][^>]*>(.*?)</td>"""), F.lit(1))
    cell = lambda n: compact_spaces(strip_html(F.coalesce(F.get(cells, n), F.lit(""))))
    classed = lambda name: compact_spaces(strip_html(F.regexp_extract("row_html", rf"""(?is)<td[^>]*class=["']{name}["'][^>]*>(.*?)</td>""", 1)))
    number = lambda c: F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(0))
    user = compact_spaces(strip_html(F.regexp_extract("row_html", r"""(?is)<a[^>]*href=["'][^"']*userdetails[^"']*[?&]id=\d+["'][^>]*>(.*?)</a>""", 1)))
    category = F.regexp_extract("row_html", r"""(?i)onclick=["']cat\((\d+)\);["']""", 1).try_cast("int")
    told = [category.alias("category_id"), number(cell(0)).alias("comments"), cell(1).alias("size"), cell(2).alias("date_text"), number(classed("sl_s")).alias("seeds"), number(classed("sl_p")).alias("peers"), user.alias("uploader")]
    return rows.filter(link != "").select(*pages.columns, link.alias("details_id"), title.alias("title"), *told).drop(html)


def page_title(html: Column) -> Column:
    """The page's title element without markup."""
    return strip_html(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Fields of a dictionary record that hold names, and of a file that hold its records.
NAME_FIELDS = ("title", "titles", "name", "names", "aliases", "synonyms", "original_title")
RECORD_FIELDS = ("data", "items", "anime", "entries", "mappings", "shows")


def dictionary(spark: SparkSession, path: str, show_id: str = "show_id", movie_id: str = "movie_id", entry_id: str = "entry_id") -> DataFrame:
    """Entries of JSON dictionary files under a path, one row for each distinct name: source, media_type, entry_id, year, name.

    A file is a list of records, an object that holds a list in one of RECORD_FIELDS, or one record; files that are no
    JSON have none. A record's id is that of a show, else of a film, else its own with its media type (tv unless it says
    movie). A name field is a text, a list of texts or an object of texts. Records without an id or a name are left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda v, field, kind: F.try_variant_get(v, f"$.{field}" if field else "$", kind)
    lists = F.coalesce(get("v", "", "array<variant>"), *[get("v", f, "array<variant>") for f in RECORD_FIELDS], F.when(F.col("v").isNotNull(), F.array("v")))
    rows = files.select(F.explode(lists).alias("r"))
    texts = [F.coalesce(get("r", f, "array<string>"), F.map_values(get("r", f, "map<string,string>")), F.array(get("r", f, "string"))) for f in NAME_FIELDS]
    names = F.transform(F.flatten(F.filter(F.array(*texts), lambda t: t.isNotNull())), compact_spaces)
    show, film, own, said = get("r", show_id, "long"), get("r", movie_id, "long"), get("r", entry_id, "long"), F.lower(get("r", "media_type", "string"))
    media = F.when(show.isNotNull(), "tv").when(film.isNotNull(), "movie").when(said == "movie", "movie").otherwise("tv")
    found = rows.select(get("r", "source", "string").alias("source"), media.alias("media_type"), F.coalesce(show, film, own).alias("entry_id"), get("r", "year", "int").alias("year"), F.array_distinct(names).alias("names"))
    return found.filter("entry_id IS NOT NULL").select("source", "media_type", "entry_id", "year", F.explode("names").alias("name")).filter("name <> ''")


def nested(rows: DataFrame, key: str, details: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`, the sorted distinct values of their details (key, value) as an array; empty without any."""
    lists = details.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
