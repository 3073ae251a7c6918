import collections
import random

import numpy as np
import pytest

from sitewise.llm.bwt import repeated_windows
from sitewise.llm.substring_dedup import cut_repeats


def brute(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[p:p + size] for r in raws for p in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - size + 1):
            if seen[r[p:p + size]] > 1:
                gone[p:p + size] = True
        out.append((len(r), int(gone.sum()), int(((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())), bytes(b for b, g in zip(r, gone) if not g)))
    return out


@pytest.mark.parametrize("size", [25, 50, 100])
def test_merged_transforms_against_counting(size):
    rnd = random.Random(size)
    for _ in range(15):
        base = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 300))) for _ in range(3)]
        strings = []
        for _ in range(rnd.randint(1, 8)):
            b = rnd.choice(base)
            strings.append(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 40))) + b[rnd.randint(0, len(b)):] + rnd.choice([b"", b"z" * 150, b"ab" * 40]))
        weights = [rnd.choice([1, 1, 2]) for _ in strings]
        seen = collections.Counter()
        for s, w in zip(strings, weights):
            for p in range(len(s) - size + 1):
                seen[s[p:p + size]] += w
        want = [[seen[s[p:p + size]] > 1 for p in range(len(s) - size + 1)] for s in strings]
        assert [m.tolist() for m in repeated_windows(strings, weights, size, rnd.choice([50, 300, 10**6]))] == want


@pytest.mark.parametrize("group_bytes", [4 << 20, 1000])
def test_cut_matches_brute_force(spark, group_bytes):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(120))
    texts = []
    for i in range(25):
        w = [word() for _ in range(rnd.randint(0, 250))]
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(w))
            cut = rnd.randint(0, 200)
            w[at:at] = [passage[cut:cut + rnd.randint(300, 700)]]
        texts.append(" ".join(w))
        if rnd.random() < 0.4:
            edited = list(texts[-1])
            for _ in range(3):
                if edited:
                    edited[rnd.randrange(len(edited))] = "#"
            texts.append("".join(edited))
    texts += [None, "", "a" * 399, "b" * 1500, "ab" * 600, texts[0], texts[0], "x" * 399 + "y"]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    rows += [(50_000, passage * 2, 1), (50_000, passage * 2, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = sorted(((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in cut_repeats(df, group_bytes=group_bytes).collect()))
    assert got == sorted(brute([t for _, t, _ in rows], 400))


def test_empty_table(spark):
    assert cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_400_bytes_take_eight_rounds(monkeypatch):
    from sitewise.llm import bwt

    depths, merge = [], bwt.merge
    monkeypatch.setattr(bwt, "merge", lambda shards, depth: depths.append(depth) or merge(shards, depth))
    rnd = random.Random(4)
    passage = bytes(rnd.choice(b"abcd") for _ in range(600))
    strings = [passage[rnd.randint(0, 150):] + bytes([65 + i]) * rnd.randint(0, 300) for i in range(40)]
    seen = collections.Counter(s[p:p + 400] for s in strings for p in range(len(s) - 399))
    want = [[seen[s[p:p + 400]] > 1 for p in range(len(s) - 399)] for s in strings]
    assert [m.tolist() for m in bwt.repeated_windows(strings, [1] * 40, 400, 2000)] == want
    assert depths == [8]


def test_segments_are_listed_without_searching_all_grams(monkeypatch):
    from sitewise.llm import substring_dedup as sd

    def isin(*_):
        raise AssertionError("every gram was searched among the minimizers")

    monkeypatch.setattr(np, "isin", isin)
    rnd = random.Random(9)
    line = bytes(rnd.choice(b"abcdefgh ") for _ in range(90))
    plain = bytes(rnd.choice(b"abcdefgh ") for _ in range(2500))
    again = 0
    for raw in (plain, plain[:700] + line * 9 + plain[700:], b"a" * 1200, line + plain[:150] + line + plain[150:400], plain[:399], b""):
        found = sd.segments_of(raw, 400)
        assert sum(n for _, _, n, *_ in found) == max(len(raw) - 399, 0)
        for key, a, n, twice, c1, c2 in found:
            grams = sd._gram_hashes(raw[a:a + n + 399]).view(np.int64).tolist()
            assert all(min(np.array(grams[i:i + 337]).view(np.uint64)) == np.int64(key).view(np.uint64) for i in range(n))
            assert twice == (grams.count(key) > 1)
            again += twice
    assert again
    same = [s for s in sd.segments_of(plain + line, 400)[1:-2]]
    moved = {s[0]: s for s in sd.segments_of(line + plain + line, 400)}
    assert all((moved[k][2:], moved[k][1] - a) == ((n, *rest), 90) for k, a, n, *rest in same)
