import numpy as np

from tramline.llm import chroma, melodies

RNG = np.random.default_rng(8)


def _song(n):
    return [float(x) for x in RNG.normal(0, 0.5, n)]


def brute_fingerprint(frames):
    """The filters summed cell by cell."""
    out = []
    for s in range(len(frames) - 15):
        w, code = frames[s : s + 16], 0
        for kind, low, height in chroma.filters():
            a = b = 0.0
            for t in range(16):
                for c in range(low, low + height):
                    left, early = c < low + height // 2, t < 8
                    if (left, early, left == early, 5 <= t < 11)[kind]:
                        a += w[t][c]
                    else:
                        b += w[t][c]
            a, b = (a / 0.375, b / 0.625) if kind == 3 else (a / 0.5, b / 0.5)
            v, outer = (a - b) / (a + b) if a + b > 1e-6 else 0.0, chroma.OUTER[height]
            code = code << 2 | (0 if v <= -outer else 1 if v <= 0 else 3 if v <= outer else 2)
        out.append(code)
    return out


def test_filters_are_distinct_and_inside():
    found = chroma.filters()
    assert len(set(found)) == 16 and all(0 <= low and low + h <= 12 and h % 2 == 0 for _, low, h in found)


def test_fingerprint_matches_brute_force():
    frames = chroma.chroma(np.frombuffer(melodies.melody(_song(40)), "<i2") / 32768.0)
    assert np.allclose(frames.sum(axis=1), 1)
    got, want = chroma.fingerprint(frames).tolist(), brute_fingerprint(frames)
    # sums by integral image and by cell may differ in the last place, at a threshold
    assert len(got) == len(want) and sum((p ^ q).bit_count() for p, q in zip(got, want)) <= 1
    pure = chroma.chroma(np.sin(2 * np.pi * 440 * np.arange(8192) / chroma.RATE))
    assert (pure.argmax(axis=1) == 0).all() and pure.max() > 0.9


def brute_align(prints, every):
    by = {}
    for i, codes in prints:
        by.setdefault(tuple(codes), []).append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in by.items()}
    out = [("member", i, least[tuple(c)], None, None, None) for i, c in prints]
    for x, ids in by.items():
        if not any(i is not None and i % every == 0 for i in ids):
            continue
        for y in by:
            if y == x or least[y] is None:
                continue
            tried = []
            for o in range(-len(y), len(x) + 1):
                pairs = [(x[k + max(o, 0)], y[k + max(-o, 0)]) for k in range(min(len(x) - max(o, 0), len(y) - max(-o, 0)))]
                if len(pairs) >= chroma.LEAST_OVERLAP:
                    errors = sum(((p ^ q) & 0xFFFFFFFF).bit_count() for p, q in pairs) / (32 * len(pairs))
                    if errors <= chroma.bound(len(pairs)):
                        tried.append((errors, abs(o), o))
            if tried:
                errors, _, o = min(tried)
                out.append(("match", least[x], least[x], least[y], o, round(errors, 9)))
    return sorted(out, key=str)


def test_align(spark):
    song = _song(90)
    songs = {0: song[:60], 1: song[:60], 2: song[20:80], 4: _song(60), 5: song[:50] + [song[50] + 0.5] + song[51:60], 8: _song(60), 9: [0.0] * 64, 12: [0.0] * 80, 3: [0.0] * 3, 16: song[40:]}
    rows = spark.createDataFrame([*songs.items(), (7, None), (1, songs[1]), (None, songs[4]), (None, [])], "id long, values array<double>")
    prints = chroma.fingerprints(melodies.recordings(rows))
    got = chroma.align(prints, 4).collect()
    assert {str(r) for r in chroma.align(prints, 4, block_codes=40).collect()} == {str(r) for r in got}
    found = sorted(((r.kind, r.id, r.class_id, r.match_id, r.offset, r.bit_errors if r.bit_errors is None else round(r.bit_errors, 9)) for r in got), key=str)
    assert found == brute_align([(r.id, r.codes) for r in prints.collect()], 4)
    pairs = {(r.id, r.match_id): r for r in got if r.kind == "match"}
    notes = 20 * round(melodies.NOTE_SECONDS * chroma.RATE) / chroma.HOP
    assert abs(pairs[0, 2].offset - notes) < 1 and pairs[0, 5].offset == 0 and (0, 4) not in pairs and (12, 9) in pairs
    none = spark.createDataFrame([], "id long, values array<double>")
    assert chroma.align(chroma.fingerprints(melodies.recordings(none))).count() == 0


def test_search_finds_what_brute_force_over_all_offsets_finds(spark):
    """All 2,000 recordings and 100 queries of the test table, and noisy excerpts of some."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS values")
    rows = chroma.fingerprints(melodies.recordings(vectors)).collect()
    codes = {r.id: np.array(r.codes, np.int32).view(np.uint32) for r in rows}
    for n in range(60):
        heard = np.frombuffer(melodies.melody([float(v) for v in RNG.normal(0, 0.5, 64)]), "<i2") / 32768.0
        cut = heard[int(RNG.integers(0, 30_000)) :]
        cut = cut + RNG.normal(0, 0.05, len(cut))
        codes[1_000_000 + 20 * n], codes[2_000_001 + 20 * n] = (chroma.fingerprint(chroma.chroma(x)) for x in (heard, cut))
    ids = sorted(codes)
    asked, flat = [i for i in ids if i % 20 == 0], [codes[i] for i in ids]
    longest = max(map(len, flat))
    matrix, sizes = np.zeros((len(ids), longest), np.uint32), np.array(list(map(len, flat)))
    for n, c in enumerate(flat):
        matrix[n, : len(c)] = c
    want = set()
    for i in asked:
        x = codes[i]
        for o in range(16 - longest, len(x) - 15):
            a, b = max(o, 0), max(-o, 0)
            overlap = np.minimum(len(x) - a, sizes - b)
            width = min(len(x) - a, longest - b)
            differ = np.bitwise_count(x[a : a + width] ^ matrix[:, b : b + width]) * (np.arange(width) < overlap[:, None])
            want |= {(i, ids[n]) for n in np.flatnonzero((overlap >= 16) & (differ.sum(axis=1) <= 32 * overlap * chroma.bound(np.maximum(overlap, 1)))) if ids[n] != i}
    table = spark.createDataFrame([(i, c.view(np.int32).tolist()) for i, c in codes.items()], "id long, codes array<int>")
    got = {(r.id, r.match_id) for r in chroma.align(table).filter("kind = 'match'").collect()}
    assert got == want and len(want) >= 60
    # unrelated recordings hardly ever align by chance
    assert sum(b < 1_000_000 for _, b in want) < 5
    assert np.mean([(1_000_000 + 20 * n, 2_000_001 + 20 * n) in got for n in range(60)]) > 0.95


def _near(codes, share):
    """The same codes with a share of all bits turned."""
    return codes ^ np.packbits(RNG.random((len(codes), 32)) < share, axis=1).view(np.uint32).ravel()


def test_histograms_are_short_and_drop_no_alignment(monkeypatch):
    """Sizes that differ, excerpts with as many errors as the bounds allow or nearly so, and both ways to transform back."""
    whole = [np.repeat(RNG.integers(0, 1 << 32, 40, np.uint32), 4)[: int(RNG.integers(40, 150))] for _ in range(12)]
    cuts = [_near(c[int(RNG.integers(0, 20)) : len(c) - int(RNG.integers(0, 15))], share) for c in whole for share in (0.16, 0.2, 0.24, 0.25, 0.26)]
    asked, rows = whole + cuts[::3], cuts + whole
    want = set()
    for i, x in enumerate(asked):
        for j, y in enumerate(rows):
            tried = []
            for o in range(16 - len(y), len(x) - 15):
                a, b = x[max(o, 0) :], y[max(-o, 0) :]
                n = min(len(a), len(b))
                errors = np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)
                if errors <= chroma.bound(n):
                    tried.append((errors, abs(o), o, n))
            if tried:
                errors, _, o, n = min(tried)
                want.add((i, 1000 + j, o, n, round(float(errors), 9)))
    assert len(want) > 60
    for most in (chroma.MOST_POINTS, 0):
        monkeypatch.setattr(chroma, "MOST_POINTS", most)
        got = set()
        for a in chroma._by_length(np.arange(len(asked)), asked):
            for b in chroma._by_length(1000 + np.arange(len(rows)), rows):
                i, j, offset, overlap, errors = chroma.matches(a, b, chroma.MOST_ERRORS, chroma.LEAST_OVERLAP)
                got |= set(zip(i.tolist(), j.tolist(), offset.tolist(), overlap.tolist(), errors.round(9).tolist()))
        assert got == want


def test_spectra_are_as_short_as_the_overlaps_allow():
    """10 kB a query at most; 34 kB where all frequencies of a signal of over twice both lengths were taken."""
    kept, (some,) = {}, chroma._by_length(np.arange(64), [RNG.integers(0, 1 << 32, 47, np.uint32) for _ in range(64)])
    chroma.matches(some, some, chroma.MOST_ERRORS, chroma.LEAST_OVERLAP, kept)
    assert 0 < sum(k.nbytes for k in kept.values()) / 64 < 10_000
