"""What a message says of a release, and how its text changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions.text import compact_spaces, let, rx


def event_label(old_text: Column, previous_progress: Column, progress: Column, previous_item: Column) -> Column:
    """UPDATE for changed texts or progress and for releases delivered before, else NEW."""
    moved = (compact_spaces(previous_progress) != "") & (compact_spaces(progress) != "") & (compact_spaces(previous_progress) != compact_spaces(progress))
    return F.when((compact_spaces(old_text) != "") | moved | previous_item.isNotNull(), "UPDATE").otherwise("NEW")


def media_badge(media: Column) -> Column:
    low = F.lower(compact_spaces(media))
    return F.upper(F.coalesce(F.nullif(low, F.lit("")), F.lit("item")))


def quality_badge(video_format: Column, title: Column) -> Column:
    """The format with `p` after digits; taken from the title if the format is blank."""
    own = compact_spaces(video_format)
    named = F.regexp_extract(compact_spaces(title), rx(r"(?<!\d)(720|1080|2160)p\b"), 1)
    chosen = F.when(own != "", own).otherwise(named)
    return F.when(F.rlike(chosen, F.lit(r"^[0-9]+$")), F.concat(chosen, F.lit("p"))).otherwise(chosen)


def route(names: Column) -> Column:
    """The first two distinct rule names and how many more there are."""
    own = F.array_distinct(F.filter(F.transform(names, compact_spaces), lambda n: n != ""))
    rest = F.size(own) - 2
    return F.concat(F.array_join(F.slice(own, 1, 2), " | "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise(""))


def shows_rating(rating: Column, votes: Column) -> Column:
    return F.coalesce((rating > 0) & (F.coalesce(votes, F.lit(0)) >= 20), F.lit(False))


def rating(text: Column) -> Column:
    """A rating from 0 to 10 that a text names, or null."""
    named = F.regexp_extract(text, rx(r"(?:rating|рейтинг|imdb|kinopoisk|кп)\D{0,8}(\d(?:[.,]\d)?)"), 1)
    share = F.regexp_extract(text, rx(r"\b(\d(?:[.,]\d)?)\s*/\s*10\b"), 1)
    return F.regexp_replace(F.coalesce(F.nullif(named, F.lit("")), F.nullif(share, F.lit(""))), ",", ".").cast("double")


def signed_keywords(text: Column) -> Column:
    """struct(include, exclude): comma-joined words after a plus and after a minus."""
    parts = F.split(compact_spaces(text), r"[\s,;]+")
    pick = lambda sign: F.array_join(F.transform(F.filter(parts, lambda p: p.startswith(sign) & (F.length(p) > 1)), lambda p: F.substring(p, 2, 1 << 30)), ",")
    return F.struct(pick("+").alias("include"), pick("-").alias("exclude"))


def text_change(old: Column, new: Column) -> Column:
    """struct(added, removed): lines of one text that the other lacks, trimmed, blanks left out."""
    lines = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), compact_spaces), lambda x: x != ""))
    return F.struct(F.array_except(lines(new), lines(old)).alias("added"), F.array_except(lines(old), lines(new)).alias("removed"))


# The heads of the messages that carry a release's text, and what stands before its lines.
CHANGED, UNCHANGED, CONTINUED = "🔄 <b>Релиз (изменился):</b>", "📎 <b>Релиз:</b>", "📎 <b>Релиз (продолжение):</b>"
ADDED, REMOVED, SAME = "  ➕ ", "  ➖ ", "  "
LEAST_SHOWN = 256


def _shown(c: Column) -> Column:
    """A text as markup."""
    return reduce(lambda out, x: F.replace(out, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), compact_spaces), lambda x: x != "")


def release_messages(title: Column, text: Column, old: Column, most: int = 3500) -> Column:
    """Messages as markup, each of at most `most` visible characters where its lines allow: a head, a blank line, lines.

    With an old text new lines are marked and those it had besides come last, after a blank line. Lines are packed in
    order as far as they fit; markup and references count by what they show. A line too long for a message of its own
    is cut there, but one that follows others goes on whole into the next. Blank texts have no messages.
    """
    own, former = _lines(text), _lines(old)
    changed = F.size(former) > 0
    line = lambda mark, x, bold=False: F.struct(F.concat(F.lit(mark), x).alias("plain"), F.lit(mark).alias("mark"), x.alias("text"), F.lit(bold).alias("bold"))
    blank = F.struct(F.lit("").alias("plain"), F.lit("").alias("mark"), F.lit("").alias("text"), F.lit(False).alias("bold"))

    def build(args: Column) -> Column:
        now, past, name = args["now"], args["past"], args["name"]
        kept = F.transform(now, lambda x: F.when(args["changed"] & ~F.array_contains(past, x), line(ADDED, x, True)).otherwise(line(SAME, x)))
        gone = F.transform(F.filter(past, lambda x: ~F.array_contains(now, x)), lambda x: line(REMOVED, x))
        every = F.concat(kept, F.when(F.size(gone) > 0, F.array(blank)).otherwise(F.slice(F.array(blank), 1, 0)), gone)
        first = F.when(args["changed"], CHANGED).otherwise(UNCHANGED)
        visible = lambda head: F.length(F.regexp_replace(head, "</?b>", "")) + 1 + F.length(name)
        return let(every, lambda lines: pack(lines, F.struct(first.alias("first"), visible(first).alias("n_first"), visible(F.lit(CONTINUED)).alias("n_next")), name))

    def pack(lines: Column, head: Column, name: Column) -> Column:
        state = lambda begun, count, n: F.struct(begun.alias("begun"), count.cast("int").alias("count"), n.cast("int").alias("n"))
        begin = lambda i, cut_off: F.array(F.struct(i.alias("at"), F.lit(cut_off).alias("cut")))
        none = F.slice(F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("cut"))), 1, 0)

        def step(s: Column, x: Column) -> Column:
            size, fresh = x["n"], s["count"] == 0
            alone = F.greatest(size - 2, F.lit(0))  # a message does not begin with spaces
            body = F.when(s["n"] == 0, alone).otherwise(s["n"] + 1 + size)
            over = F.when(F.size(s["begun"]) <= F.when(fresh, 0).otherwise(1), head["n_first"]).otherwise(head["n_next"]) + 2 + F.when(size == 0, s["n"]).otherwise(body) > most
            return (
                F.when(fresh & over, state(F.concat(s["begun"], begin(x["i"], True)), F.lit(0), F.lit(0)))
                .when(fresh, state(F.concat(s["begun"], begin(x["i"], False)), F.lit(1), body))
                .when(over, state(F.concat(s["begun"], begin(x["i"], False)), F.lit(1), alone))
                .otherwise(state(s["begun"], s["count"] + 1, body))
            )

        sized = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), F.length(x["plain"]).alias("n")))
        begun = F.aggregate(sized, state(none, F.lit(0), F.lit(0)), step, lambda s: s["begun"])
        return let(begun, lambda b: F.transform(b, lambda c, k: message(lines, head, name, c, k, F.coalesce(F.get(b, k + 1)["at"], F.size(lines) + 1))))

    def message(lines: Column, head: Column, name: Column, c: Column, k: Column, to: Column) -> Column:
        room = F.greatest(F.lit(LEAST_SHOWN), F.lit(most) - F.when(k == 0, head["n_first"]).otherwise(head["n_next"]))
        cut_off = c["cut"]

        def markup(x: Column) -> Column:
            long = cut_off & (F.length(x["plain"]) - 2 > room)
            shown = F.when(long, F.rtrim(F.substring(x["text"], F.lit(1), F.greatest(room - F.length(x["mark"]), F.lit(0))))).otherwise(x["text"])
            return F.concat(x["mark"], F.when(x["bold"], F.concat(F.lit("<b>"), _shown(shown), F.lit("</b>"))).otherwise(_shown(shown)))

        own_head = F.when(k == 0, head["first"]).otherwise(F.lit(CONTINUED))
        body = F.array_join(F.transform(F.slice(lines, c["at"], to - c["at"]), markup), "\n")
        return F.concat(own_head, F.lit(" "), _shown(name), F.lit("\n\n"), body)

    args = F.struct(own.alias("now"), former.alias("past"), compact_spaces(title).alias("name"), changed.alias("changed"))
    return let(args, lambda a: F.when(F.size(a["now"]) > 0, build(a)).otherwise(F.array().cast("array<string>")))


def magnet(info_hash: Column, title: Column) -> Column:
    """A magnet link with the title percent-encoded but for slashes; empty without a hash."""
    own = F.upper(compact_spaces(info_hash))
    name = F.replace(F.replace(F.replace(F.url_encode(compact_spaces(title)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    return F.when(own != "", F.concat(F.lit("magnet:?xt=urn:btih:"), own, F.lit("&dn="), F.replace(name, F.lit("*"), F.lit("%2A")))).otherwise("")
