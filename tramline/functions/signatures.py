"""Identity of releases, versions and delivery events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, first_filled


def release_key(*columns: Column) -> Column:
    """The 5 to 12 digits of a release id, taken from the first column that holds one (plain, uid or link)."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^|[:=])\s*([0-9]{5,12})(?![0-9])", 1), F.lit("")) for c in columns])


def source_uid(key: Column, guid: Column, link: Column, title: Column, cleaned: Column) -> Column:
    """Identity of a release: its key under the source's name, else its guid, else its link, else a hash of its titles."""
    titles = F.sha1(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(cleaned, F.lit(""))))
    return F.coalesce(F.concat(F.lit("source:"), F.nullif(compact_spaces(key), F.lit(""))), first_filled(compact_spaces(guid), compact_spaces(link)), titles)


def _norm(c: Column, blank: str) -> Column:
    return F.coalesce(F.nullif(F.lower(compact_spaces(c.cast("string"))), F.lit("")), F.lit(blank))


def audio_signature(tracks: Column) -> Column:
    """Sorted labels, repeated ones with their count: `2x:label,label`."""
    low = F.filter(F.transform(tracks, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    labels = F.array_sort(F.array_distinct(low))
    many = F.transform(labels, lambda label: F.struct(label.alias("label"), F.size(F.filter(low, lambda t: t == label)).alias("n")))
    return F.array_join(F.transform(many, lambda x: F.when(x["n"] > 1, F.concat(x["n"].cast("string"), F.lit("x:"), x["label"])).otherwise(x["label"])), ",")


def audio_signature_of_counts(counts: Column) -> Column:
    """The same of an array of struct(label, n) with distinct trimmed lower-case labels, as a grouping by label gives them."""
    return F.array_join(F.transform(F.array_sort(counts), lambda x: F.when(x["n"] > 1, F.concat(x["n"].cast("string"), F.lit("x:"), x["label"])).otherwise(x["label"])), ",")


def variant_text(media: Column, progress: Column, video_format: Column, release: Column, audio: Column) -> Column:
    """What tells a release's variants apart; films have no progress."""
    kind = _norm(media, "movie")
    tail = [_norm(video_format, "nofmt"), _norm(release, "norelease"), _norm(audio, "noaudio")]
    return F.when(kind == "movie", F.concat_ws("|", kind, *tail)).otherwise(F.concat_ws("|", kind, _norm(progress, "noprogress"), *tail))


#: Parts of a variant after its media type, each with what stands for none.
VARIANT_PARTS = (("progress", "noprogress"), ("format", "nofmt"), ("release", "norelease"), ("audio", "noaudio"))


def variant_parts(media: Column, progress: Column, video_format: Column, release: Column, audio: Column) -> Column:
    """struct(media, progress, format, release, audio) of a variant, normalized."""
    given = (progress, video_format, release, audio)
    return F.struct(_norm(media, "movie").alias("media"), *[_norm(c, none).alias(name) for c, (name, none) in zip(given, VARIANT_PARTS)])


def variant_summary(parts: Column) -> Column:
    return F.concat_ws(" | ", parts["media"], *[F.concat(F.lit(f"{name}="), parts[name]) for name, _ in VARIANT_PARTS])


def variant_change(old: Column, new: Column) -> Column:
    """What differs between two variants' parts, in words; a null old one is none."""
    said = F.concat_ws("; ", *[F.when(old[name] != new[name], F.concat(F.lit(f"{name} "), old[name], F.lit(" -> "), new[name])) for name, _ in VARIANT_PARTS])
    return F.when(old.isNull(), "first version").when(said == "", "metadata refresh").otherwise(said)


def variant_signature(*args: Column) -> Column:
    return F.sha1(variant_text(*args))


def version_signature(uid: Column, media: Column, variant: Column) -> Column:
    return F.sha1(F.concat_ws("|", _norm(uid, "unknown"), _norm(media, "movie"), variant))


def release_event(user: Column, identity: Column, version: Column, item: Column) -> Column:
    """Key under which a user gets a version once."""
    return F.concat_ws(":", F.lit("release"), user, identity, first_filled(version.cast("string"), item.cast("string"), F.lit("noversion")))


def text_event(user: Column, identity: Column, text: Column, item: Column) -> Column:
    """Key under which a user gets a changed release text once."""
    own = F.coalesce(F.nullif(compact_spaces(text), F.lit("")), F.concat(F.lit("item:"), item.cast("string")))
    return F.concat_ws(":", F.lit("release_text"), user, identity, F.sha1(own))


def group_event(user: Column, group: Column, members: Column) -> Column:
    """Key of a grouped message: members are `identity:version` texts."""
    print_ = F.sha1(F.array_join(F.array_sort(members), "|"))
    return F.concat_ws(":", F.lit("grouped"), user, first_filled(group.cast("string"), print_), print_)


def quiet(hour: Column, start: Column, end: Column) -> Column:
    """True inside the hours [start, end), which may wrap midnight; equal or missing bounds mean never."""
    inside = F.when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
    return F.coalesce(F.when(start.isNull() | end.isNull() | (start == end), F.lit(False)).otherwise(inside), F.lit(False))


def local_hour(at: Column, zone: Column) -> Column:
    return F.hour(F.from_utc_timestamp(at, zone))
