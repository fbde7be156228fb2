"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased letters with one space for anything between. Each language has a model of ORDER characters:
discounted counts at the highest order, continuation counts below. N-grams are packed into 64-bit keys of 16 bits a
character and kept in sorted arrays, with one column of log probabilities for each language, resolved through their
backoffs. No n-gram is left out: a model too large to be broadcast is computed by groupings and joins over all of them
and its arrays are mapped from files, with the same results. A text goes to the language of least cross-entropy a
character; one whose cross-entropy lies over a high quantile of that language's calibration texts, which were not
counted, is marked as rejected.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import batches_of, cut

ORDER = 4
BITS = 16
SPACE = 32
#: Cells of a model that is built on the driver and broadcast; a larger one is built by joins and mapped from files.
MOST_CELLS = 16_000_000
#: Entries of a file piece that one row of a large model's table carries to the driver.
PIECE = 500_000
#: Characters that are handled at once, and distinct n-grams that a counting task holds before it merges them.
CHUNK_CHARS = 1_000_000
MERGE_OVER = 4_000_000
#: Texts of a language that calibrate rejection and are not counted: so many at most and this share at most, of languages
#: with at least so many texts; the quantile, and the characters after which a score is no surer.
MOST_CALIBRATION, CALIBRATION_SHARE, LEAST_TEXTS = 1_000, 0.1, 50
REJECT_QUANTILE = 0.995
SURE_CHARS = 60


@lru_cache(1)
def _table() -> np.ndarray:
    """Code of each character below 65536: its lower case if a letter, else a space."""
    out = np.full(1 << BITS, SPACE, np.uint64)
    for c in range(1 << BITS):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes(text: str) -> np.ndarray:
    """Codes of a text after ORDER - 1 spaces; the few letters from 65536 on share the codes of the private use area."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = points >= 1 << BITS
    out = _table()[np.where(high, SPACE, points)]
    if high.any():
        distinct, back = np.unique(points[high], return_inverse=True)
        fold = np.array([0xE000 + ord(c[0]) % 6400 if (c := chr(p).lower()).isalpha() else SPACE for p in distinct.tolist()], np.uint64)
        out[high] = fold[back]
    pad = np.full(ORDER - 1, SPACE, np.uint64)
    space = out == SPACE
    again = space & np.r_[True, space[:-1]] if len(out) else space
    return np.concatenate([pad, out[~again]])


def _keys(all_codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of every text, one for each character, and their number in each text."""
    flat = np.concatenate(all_codes)
    key = np.zeros(len(flat), np.uint64)
    for back in range(ORDER):
        key[ORDER - 1 :] |= flat[ORDER - 1 - back : len(flat) - back] << np.uint64(BITS * back)
    sizes = np.array([len(c) for c in all_codes])
    keep = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    for back in range(ORDER - 1):
        keep[starts + back] = False
    return key[keep], sizes - (ORDER - 1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, many = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, many = flat[order], many[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(many, first) if len(first) else many


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = _merged(*parts)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int64)), pa.array(counts[at : at + 100_000])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for some in batches_of(texts, [len(t) for t in texts], CHUNK_CHARS):
                keys, counts = np.unique(_keys([codes(t) for t in some])[0], return_counts=True)
                parts = held.setdefault(lang, ([], []))
                parts[0].append(keys)
                parts[1].append(counts.astype(np.int64))
                if sum(map(len, parts[0])) > MERGE_OVER and len(parts[0]) > 1:
                    merged = _merged(*parts)
                    held[lang] = ([merged[0]], [merged[1]])
        if sum(len(k) for parts in held.values() for k in parts[0]) > 2 * MERGE_OVER:
            yield from out()
    yield from out()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of all n-grams of the whole texts, pre-aggregated in each task."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << BITS * order) - 1)


class KneserNey:
    """One language: probabilities of seen n-grams and backoff weights of their contexts, for each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> None:
        self.floor = 1.0 / alphabet
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        levels = {ORDER: (keys, counts)}
        for order in range(ORDER - 1, 0, -1):
            levels[order] = np.unique(_suffix(levels[order + 1][0], order), return_counts=True)
        for order in range(1, ORDER + 1):
            keys, counts = levels[order]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            context = keys >> np.uint64(BITS)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, len(keys)])
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            gamma = discount * sizes / total
            lower = self.probability(order - 1, _suffix(keys, order - 1))
            self.grams[order] = (keys, (counts - discount) / np.repeat(total, sizes) + np.repeat(gamma, sizes) * lower)
            self.contexts[order] = (context[first], gamma)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.floor)
        if not order:
            return out
        at, seen = _find(self.grams[order][0], keys)
        if seen.any():
            out[seen] = self.grams[order][1][at[seen]]
        rest = keys[~seen]
        if len(rest):
            out[~seen] = self.backoff(order, rest >> np.uint64(BITS)) * self.probability(order - 1, _suffix(rest, order - 1))
        return out

    def backoff(self, order: int, contexts: np.ndarray) -> np.ndarray:
        at, seen = _find(self.contexts[order][0], contexts)
        return np.where(seen, self.contexts[order][1][at] if len(self.contexts[order][1]) else 1.0, 1.0)


@dataclass
class Model:
    """All languages side by side; limits are the rejection bounds in nats a character."""

    languages: list[str]
    floor: float
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    limits: list[float] = field(default_factory=list)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """A row for each n-gram, a column for each language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        rest, debt = np.arange(len(keys)), None
        for order in range(ORDER, 0, -1):
            own = _suffix(keys[rest], order)
            at, seen = _find(self.grams[order][0], own)
            out[rest[seen]] += self.grams[order][1][at[seen]]
            rest, own = rest[~seen], own[~seen]
            if not len(rest):
                return out
            at, seen = _find(self.contexts[order][0], own >> np.uint64(BITS))
            debt = self.contexts[order][1][at[seen]]
            out[rest[seen]] += debt
        out[rest] += np.float32(np.log(self.floor))
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy a character of each text under each language; NaN for texts without letters."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        found = [(n, c) for n, t in enumerate(texts) if t and len(c := codes(t)) > ORDER - 1]
        most = max(10_000, CHUNK_CHARS * 8 // max(8, len(self.languages)))
        for some in batches_of(found, [len(c) for _, c in found], most):
            keys, sizes = _keys([c for _, c in some])
            sums = np.add.reduceat(self.log_probabilities(keys), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            out[[n for n, _ in some]] = -sums / sizes[:, None]
        return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of sorted keys and counts of each language."""
    languages = sorted(counts)
    alphabet = 1 + len(np.unique(np.concatenate([np.zeros(0, np.uint64)] + [_suffix(k, 1) for k, _ in counts.values()])))
    models = [KneserNey(*counts[x], alphabet) for x in languages]
    grams, contexts = {}, {}
    none = np.zeros(0, np.uint64)
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([none] + [m.grams[order][0] for m in models]))
        grams[order] = (keys, np.log(np.stack([m.probability(order, keys) for m in models], axis=1) if models else np.zeros((0, 0))).astype(np.float32))
        keys = np.unique(np.concatenate([none] + [m.contexts[order][0] for m in models]))
        contexts[order] = (keys, np.log(np.stack([m.backoff(order, keys) for m in models], axis=1) if models else np.zeros((0, 0))).astype(np.float32))
    return Model(languages, 1.0 / alphabet, grams, contexts, [float("inf")] * len(languages))


def levels_of(counts: DataFrame, alphabet: int) -> DataFrame:
    """(lang, level, gram, value) of all languages: what KneserNey has, as logarithms, by groupings and joins.

    Levels 1 to ORDER are probabilities of n-grams, ORDER + 1 to 2 * ORDER the backoff weights of their contexts.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")
        levels[order] = cut(levels[order + 1].select("lang", suffix).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    out, lower = [], None
    for order in range(1, ORDER + 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(once == 0, 0.5).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / F.greatest(once + 2 * twice, F.lit(1)))))
        discounts = levels[order].groupBy("lang").agg(discount.alias("discount"))
        rows = levels[order].join(F.broadcast(discounts), "lang").withColumn("context", F.shiftrightunsigned("gram", BITS))
        contexts = rows.groupBy("lang", "context").agg((F.first("discount") * F.count("*") / F.sum("n")).alias("gamma"), F.sum("n").alias("total"))
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / alphabet))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(lower, ["lang", "suffix"])
        rows = cut(rows.select("lang", "gram", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")))
        lower = rows.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        for level, table, key, value in ((order, rows, "gram", "p"), (ORDER + order, contexts, "context", "gamma")):
            out.append(table.select("lang", F.lit(level).alias("level"), F.col(key).alias("gram"), F.ln(value).cast("float").alias("value")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionAll(more)
    return rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one language and level in sorted rows, as bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    name, size = None, 0

    def out() -> pa.RecordBatch:
        keys, values = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_pylist([{"lang": name[0], "level": name[1], "keys": keys.astype(np.uint64).tobytes(), "levels": values.astype(np.float32).tobytes()}], pa.schema([("lang", pa.string()), ("level", pa.int32()), ("keys", pa.binary()), ("levels", pa.binary())]))

    for batch in batches:
        langs, level = batch.column("lang").dictionary_encode(), batch.column("level").to_numpy()
        lang, keys, values = langs.indices.to_numpy(), batch.column("gram").to_numpy(), batch.column("value").to_numpy()
        starts = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (level[1:] != level[:-1])]) if len(lang) else []
        for a, b in zip(starts, [*starts[1:], len(lang)]):
            own = (langs.dictionary[int(lang[a])].as_py(), int(level[a]))
            if held and (own != name or size >= PIECE):
                yield out()
                held, size = [], 0
            name = own
            held.append((keys[a:b], values[a:b]))
            size += b - a
    if held:
        yield out()


@lru_cache(4)
def _mapped(keys: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    return np.memmap(SparkFiles.get(keys), np.uint64, "r"), np.memmap(SparkFiles.get(values), np.float32, "r")


@dataclass
class MappedModel(Model):
    """A model whose arrays lie in files that every executor has; places are their ranges by language and level."""

    files: tuple[str, str] = ("", "")
    places: dict[tuple[str, int], tuple[int, int]] = field(default_factory=dict)

    def _one(self, lang: str) -> Model:
        keys, values = _mapped(*self.files)
        at = {level: slice(*self.places.get((lang, level), (0, 0))) for level in range(1, 2 * ORDER + 1)}
        grams, contexts = ({n: (keys[at[base + n]], values[at[base + n], None]) for n in range(1, ORDER + 1)} for base in (0, ORDER))
        return Model([lang], self.floor, grams, contexts)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        # sorted keys read the files from front to back
        own, back = np.unique(keys, return_inverse=True)
        out = np.empty((len(own), len(self.languages)), np.float32)
        for n, lang in enumerate(self.languages):
            out[:, n] = self._one(lang).log_probabilities(own)[:, 0]
        return out[back]


def build_mapped(counts: DataFrame, languages: list[str]) -> MappedModel:
    """The model of all counts; its arrays pass the driver piece by piece into files, which Spark sends to the executors."""
    alphabet = 1 + counts.select(F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))).distinct().count()
    # keys are unsigned: those of the upper half, which are negative longs, come last
    order = ("lang", "level", F.col("gram") < 0, "gram")
    rows = levels_of(counts, alphabet).repartitionByRange(*order).sortWithinPartitions(*order)
    tag, folder = uuid.uuid4().hex, tempfile.mkdtemp(prefix="langid-")
    names, places, end = (f"keys-{tag}", f"levels-{tag}"), {}, 0
    pieces = cut(rows.mapInArrow(_pieces, "lang string, level int, keys binary, levels binary"))
    with open(os.path.join(folder, names[0]), "wb") as keys, open(os.path.join(folder, names[1]), "wb") as values:
        for r in pieces.toLocalIterator():  # partitions and rows come in their order
            keys.write(r["keys"])
            values.write(r["levels"])
            start, end = end, end + len(r["keys"]) // 8
            places[r.lang, r.level] = (places.get((r.lang, r.level), (start,))[0], end)
    for name in names:
        counts.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return MappedModel(languages, 1.0 / alphabet, {}, {}, [float("inf")] * len(languages), names, places)


def train(docs: DataFrame, *, may_learn=None) -> Model:
    """Counts n-grams of the rows of docs(doc_id, text, lang) that may_learn admits and calibrates rejection.

    Rows with a null text or lang teach nothing. All n-grams are kept. A bounded draw of each language's texts is not
    counted and calibrates; a language of few texts is counted whole and rejects nothing.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows if may_learn is None else rows.filter(may_learn)
    texts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    shares = [(x, min(CALIBRATION_SHARE, MOST_CALIBRATION / n) if n >= LEAST_TEXTS else 0.0) for x, n in sorted(texts.items())]
    draw = F.pmod(F.xxhash64("doc_id", F.crc32("text"), F.lit("calibration")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double")), "lang").withColumn("aside", draw < F.col("share"))
    counts = cut(gram_counts(rows.filter("NOT aside")))
    sizes = {r[0]: r[1] for r in counts.groupBy("lang").count().collect()}
    if sum(sizes.values()) * len(sizes) > MOST_CELLS:
        model = build_mapped(counts, sorted(sizes))
    else:
        taken = counts.toArrow()
        lang, gram, n = (np.array(taken.column(c).to_pylist() if c == "lang" else taken.column(c).to_numpy()) for c in ("lang", "gram", "n"))
        by = {}
        for x in sorted(sizes):
            own = lang == x
            keys = gram[own].astype(np.uint64)
            order = np.argsort(keys)
            by[x] = (keys[order], n[own][order])
        model = build(by)
    if any(share for _, share in shares):
        some = predicted(rows.filter("aside").select("text", "lang"), model).filter("lang_pred = lang")
        # the quantile of few texts is widened by what it may be off
        off = F.coalesce(F.stddev_pop("cross_entropy"), F.lit(0.0)) * 3 / F.sqrt(F.count("*"))
        bounds = some.groupBy("lang").agg(F.expr(f"percentile_approx(cross_entropy, {REJECT_QUANTILE})") + off).collect()
        limits = {r[0]: r[1] for r in bounds}
        model.limits = [limits.get(x, float("inf")) for x in model.languages]
    return model


OUT = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}


def decide(model: Model, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
    """(language, score, cross-entropy, rejected) of each text."""
    out = []
    for row, text in zip(model.entropies(texts), texts):
        if not model.languages or np.isnan(row[0]):
            out.append(("und", 0.0, None, True))
            continue
        best = int(row.argmin())
        # posterior of equal priors, as if the text had SURE_CHARS characters at most
        weight = np.exp(-(row - row[best]) * min(SURE_CHARS, len(text)))
        out.append((model.languages[best], float(1 / weight.sum()), float(row[best]), bool(row[best] > model.limits[best])))
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decide(model.value, batch.column("text").to_pylist())
            for n, (name, kind) in enumerate(zip(OUT, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))):
                batch = batch.set_column(batch.schema.get_field_index(name), pa.field(name, kind), pa.array([x[n] for x in found], kind))
            yield batch

    return run


def predicted(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected; columns of these names are replaced.

    A null text and one without letters are `und` with score 0 and null cross_entropy; so is every text if no language
    was learned. With reject, rejected texts are `und` too. Ties go to the language that sorts first.
    """
    names = [n for n in docs.columns if n not in OUT]
    rows = docs.select(*[F.col(f"`{n}`") for n in names], *[F.lit(None).cast(k).alias(n) for n, k in OUT.items()])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = rows.mapInArrow(_predict(sent), rows.schema)
    return rows.withColumn("lang_pred", F.when(F.col("rejected"), "und").otherwise(F.col("lang_pred"))) if reject else rows
