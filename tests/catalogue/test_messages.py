import html
import random
import re

from pyspark.sql import functions as F

from tramline.functions import labels


def _visible(markup):
    return len(html.unescape(re.sub(r"<[^>]+>", "", markup)).strip())


def _messages(title, text, old, most):
    """The same by a loop over lines, each time measuring the whole message."""
    split = lambda t: [x for x in (" ".join(line.split()) for line in re.split("\r\n|\r|\n", t or "")) if x]
    now, past = split(text), split(old)
    if not now:
        return []
    lines = [f"  ➕ <b>{html.escape(x)}</b>" if past and x not in past else f"  {html.escape(x)}" for x in now]
    gone = [f"  ➖ {html.escape(x)}" for x in past if x not in now]
    lines += ["", *gone] if gone else []
    out, held = [], []
    head = f"{labels.CHANGED if past else labels.UNCHANGED} {html.escape(title)}"
    for line in lines:
        size = _visible(head) + 2 + _visible("\n".join([*held, line]).strip())
        if not held and size > most:
            room = max(256, most - _visible(head))
            if _visible(line) > room:
                plain = html.unescape(re.sub("<[^>]+>", "", line))[:room].rstrip()
                mark = plain[:4] if plain[2] in "➕➖" else plain[:2]
                rest = html.escape(plain[len(mark) :])
                line = mark + (f"<b>{rest}</b>" if "<b>" in line else rest)
            out.append(f"{head}\n\n{line}")
            head = f"{labels.CONTINUED} {html.escape(title)}"
        elif held and size > most:
            out.append(f"{head}\n\n" + "\n".join(held))
            head, held = f"{labels.CONTINUED} {html.escape(title)}", [line]
        else:
            held.append(line)
    return out + ([f"{head}\n\n" + "\n".join(held)] if held else [])


def test_messages_match_a_loop_and_lose_no_line(spark):
    rng = random.Random(9)
    words = ["a<b", "x & y", "слово", "🎬", "long" * 30, "q" * 700, "it's", '"']
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(14)))
    rows = [("T & <t>", text(), rng.choice([None, "", text()])) for _ in range(150)] + [("t", None, "x"), ("t", " \n ", None)]
    df = spark.createDataFrame(rows, "title string, text string, old string")
    for most in (300, 900):
        got = df.select("title", "text", "old", labels.release_messages(F.col("title"), F.col("text"), F.col("old"), most).alias("m")).collect()
        for r in got:
            assert r.m == _messages(r.title, r.text, r.old, most), (r.text, r.old)
    # nothing is cut where every line fits into a message of its own
    r = df.filter("instr(text, 'qqqq') = 0").select("text", labels.release_messages(F.lit("t"), F.col("text"), F.lit(None).cast("string"), 900).alias("m")).collect()
    for row in r:
        shown = [html.unescape(x).strip() for m in row.m for x in m.split("\n\n", 1)[1].split("\n")]
        assert shown == [" ".join(x.split()) for x in row.text.split("\n") if x.strip()]
