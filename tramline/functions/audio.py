"""Audio labels in titles and release texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, rx

# The audio labels.
LABELS = ("ДБ", "ПМ", "ЛМ", "ЛД", "ПО", "ПД", "СТ", "РУ", "БП", "АП", "МВО", "ДВО", "AVO", "DVO", "MVO", "VO", "SUB", "Оригинал")
_TIMES = "[xх×]"
PATTERN = rf"(?:(\d{{1,2}})\s*{_TIMES}\s*)?(?<!\w)({'|'.join(LABELS)})(?!\w)(?:\s*\(([^)]{{1,120}})\))?(?:\s*{_TIMES}\s*(\d{{1,2}}))?"


def variants(title: Column) -> Column:
    """array(struct(label, count)) in order of first appearance; a count stands before or after its label."""
    found = F.regexp_extract_all(compact_spaces(title), F.lit(rx(f"({PATTERN})")), F.lit(1))

    def one(match: Column) -> Column:
        part = lambda g: F.regexp_extract(match, rx(PATTERN), g)
        kind = F.when(F.lower(part(2)) == "оригинал", part(2)).otherwise(F.upper(part(2)))
        extra = compact_spaces(part(3))
        number = F.coalesce(F.nullif(part(1), F.lit("")), F.nullif(part(4), F.lit("")), F.lit("1")).cast("int")
        return F.struct(F.when(extra != "", F.concat(kind, F.lit(" ("), extra, F.lit(")"))).otherwise(kind).alias("label"), F.greatest(number, F.lit(1)).alias("count"))

    rows = F.transform(found, one)
    keys = F.transform(rows, lambda r: F.lower(r["label"]))
    firsts = F.filter(rows, lambda r, i: F.array_position(keys, F.lower(r["label"])) == i + 1)
    total = lambda key: F.aggregate(F.filter(rows, lambda r: F.lower(r["label"]) == key), F.lit(0), lambda t, r: t + r["count"])
    return F.transform(firsts, lambda r: F.struct(r["label"].alias("label"), total(F.lower(r["label"])).alias("count")))


def tracks(title: Column) -> Column:
    """Every label as often as it counts."""
    return F.flatten(F.transform(variants(title), lambda v: F.array_repeat(v["label"], v["count"])))


def episode_ranges(release_text: Column) -> Column:
    """map(studio or kind in lower case → episode range) of the audio lines; a later line wins."""
    pattern = rx(r"^\s*(?:аудио|audio)\s*\d+\s*:.*?\(([^)]+)\)\s*(\d+(?:-\d+)?)\s*сери(?:и|[яей])")
    lines = F.filter(F.split(F.coalesce(release_text, F.lit("")), "\r?\n"), lambda x: F.rlike(x, F.lit(pattern)))

    def pairs(line: Column) -> Column:
        names = F.filter(F.transform(F.split(F.regexp_extract(line, pattern, 1), ","), lambda n: F.lower(compact_spaces(n))), lambda n: n != "")
        return F.transform(names, lambda n: F.struct(n.alias("key"), F.regexp_extract(line, pattern, 2).alias("value")))

    every = F.flatten(F.transform(lines, pairs))
    names = F.transform(every, lambda p: p["key"])
    # the last of equal keys stays
    last = F.filter(every, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), p["key"]))
    return F.map_from_entries(last)


def change(before: Column, after: Column) -> Column:
    """array(struct(label, delta)) of labels whose counts differ, by label."""
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(before, lambda v: v["label"]), F.transform(after, lambda v: v["label"]))))
    count = lambda a, k: F.coalesce(F.try_element_at(F.transform(F.filter(a, lambda v: v["label"] == k), lambda v: v["count"]), F.lit(1)), F.lit(0))
    return F.filter(F.transform(labels, lambda k: F.struct(k.alias("label"), (count(after, k) - count(before, k)).alias("delta"))), lambda d: d["delta"] != 0)
