import pytest
from pyspark.sql import functions as F

from tramline.functions import progress, signatures, text, titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PROGRESS = [
    ("1 сезон: 1-7 серии из 10", (1, 1, 7, 10)),
    ("1-3 СЕЗОН: 1-8, 10 серии", (3, 1, 10, None)),
    ("2 сезон: 5 выпуск", (2, 5, 5, None)),
    ("s01e05", (1, 5, 5, None)),
    ("S2 E3 - E9", (2, 3, 9, None)),
    ("1x08", (1, 8, 8, None)),
    ("1x08-1x10", (1, 8, 10, None)),
    ("2x01-05", (2, 1, 5, None)),
    ("1-4 серии из 12", (None, 1, 4, 12)),
    ("1-4 из 12", (None, 1, 4, 12)),
    ("3 из 8", (None, 3, 3, 8)),
    ("фильм", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("value, want", PROGRESS)
def test_progress_parts(spark, value, want):
    got = one(spark, progress.parts(F.lit(value).cast("string")))
    assert (got and tuple(got)[:4]) == want


@pytest.mark.parametrize(
    "left, right, want",
    [("1-5 из 10", "1-4 из 10", 1), ("s01e05", "s02e01", -1), ("s02e01", "3 серия", -1), ("1-4 из 4", "1-5 серии", None), ("x", "s01e01", None), ("s01e01", "1x01", 0)],
)
def test_compare(spark, left, right, want):
    parts = lambda v: progress.parts(F.lit(v))
    assert one(spark, progress.compare(parts(left), parts(right))) == want
    if want is not None:
        assert one(spark, progress.compare(parts(right), parts(left))) == -want


def test_extract(spark):
    got = one(spark, progress.extract(F.lit("Local / Original (2 сезон:  1-3 серии из 8) / 2026 / s01e02")))
    assert got == "2 сезон: 1-3 серии из 8"
    assert one(spark, progress.extract(F.lit("Show s01e02-e05 720p"))) == "s01e02-e05"


def test_text(spark):
    lit = F.lit
    assert one(spark, text.compact_spaces(lit(" a \t b\n"))) == "a b"
    assert one(spark, text.strip_html(lit("<p>A &amp; B<script>x<y</script></p> c"))) == "A & B c"
    assert one(spark, text.years(lit("Film 1999 / 2001, 12345 1899 2003 1999"), 2001)) == [1999, 2001]
    assert one(spark, text.listed(lit('["ДБ", " дб ", "ПМ", ""]'))) == ["ДБ", "ПМ"] and one(spark, text.listed(lit("us, GB,,Us"))) == ["us", "GB"]
    assert one(spark, text.release_type(lit("2026 / BDRip-AVC"))) == "bdrip" and one(spark, text.release_type(lit("Blu-Ray Remux"))) == "blu-ray remux"
    assert one(spark, text.video_format(lit("WEB 4K"))) == "2160" and one(spark, text.shorten(lit("abcdef"), 4)) == "abc…"
    for word, hay, want in (("hd", "a hdr b", False), ("hd", "a hd, b", True), ("дб", "звук ДБ", True), ("rip", "webrip", False), ("webr", "a webrip", True)):
        assert one(spark, text.keyword_hit(text.haystack(lit(hay)), lit(word))) is want, word


def test_signatures(spark):
    lit = F.lit
    tracks = F.array(*map(lit, ["ПМ", "ДБ", "дб", " "]))
    assert one(spark, signatures.audio_signature(tracks)) == "2x:дб,пм"
    assert one(spark, signatures.variant_text(lit("TV"), lit("1-2 из 3"), lit(""), lit(None).cast("string"), lit("дб"))) == "tv|1-2 из 3|nofmt|norelease|дб"
    assert one(spark, signatures.variant_text(lit(""), lit("1-2 из 3"), lit("720"), lit("WEBRip"), lit(""))) == "movie|720|webrip|noaudio"
    assert one(spark, signatures.release_key(lit("kinds:x"), lit("https://x/details.php?id=1234567"))) == "1234567"
    for hour, start, end, want in ((23, 22, 6, True), (5, 22, 6, True), (6, 22, 6, False), (10, 9, 17, True), (9, 9, 9, False)):
        assert one(spark, signatures.quiet(lit(hour), lit(start), lit(end))) is want
    at = F.to_timestamp(lit("2024-03-31 00:30:00"))
    assert one(spark, signatures.local_hour(at, lit("Europe/Berlin"))) == 1 and one(spark, signatures.local_hour(F.to_timestamp(lit("2024-03-31 01:30:00")), lit("Europe/Berlin"))) == 3


def test_titles(spark):
    assert titles.split_segments("A / B (x/y) / [1/2] C /") == ["A", "B (x/y)", "[1/2] C"]
    got = one(spark, titles.parse_title(F.lit("Местный / Original / 2026 / 1 сезон: 1-7 серии из 10 / ДБ, ПМ (Studio) / WEBRip (1080p)")))
    assert (got.title_ru, got.title_en, got.year, got.progress, got.audio, got.release_type) == ("Местный", "Original", 2026, "1 сезон: 1-7 серии из 10", ["ДБ", "ПМ (Studio)"], "WEBRip (1080p)")
    assert titles.ratio("Hello", "hello") == 1.0 and titles.ratio(None, None) == titles.ratio("", "abc") == 0.0 and 0.5 < titles.ratio("Breaking Bad", "Breaking") < 1
    assert titles.ratio("abc", "abc") == 1.0 and titles.ratio("", "a") == 0.0


def test_tokens(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    norm = lambda t: one(text.normalized(F.lit(t)))
    assert norm("  Hello   World  ") == "hello world" and norm("<b>Test</b> &amp; More") == "test more" and norm("Привет мир") == "привет мир" and norm(None) == ""
    assert norm("İstanbul Şehir") == "istanbul sehir" and norm("Ærø Œuvre ﬁn Ёлки йод Ⅻ") == "aer oeuvre fin елки иод xii"
    own = lambda t: one(text.tokens(F.lit(t)))
    assert own("The Lord of the Rings") == ["lord", "rings"] and own("") == own(None) == [] and own("The of") == ["of", "the"] and own("В доме и на улице") == ["доме", "улице"]
    overlap = lambda a, b: one(text.token_overlap(text.tokens(F.lit(a)), text.tokens(F.lit(b))))
    assert overlap("Красный дом", "Дом красный") == 1.0 and overlap("the house of cards", "house cards") == 1.0 and overlap("Alpha Beta", "Gamma Delta") == 0.0 and overlap("Breaking Bad", "Breaking Good") == 0.5
