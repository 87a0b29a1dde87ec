import random
import unicodedata

import numpy as np
import pytest

from lavra.llm import leaks, mixtures


def made(n_docs=120, n_items=12, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"palavra{i}é" for i in range(300)]
    sample = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(sample(40))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = sample(60)
        if d % 3 == 0:
            source = items[d % n_items][1].split()
            k = rng.choice([11, 12, 13, 14, 20])
            at = rng.randrange(0, 40 - k)
            words[20:20] = source[at : at + k]
        text = " ".join(words)
        if d % 2:
            text = unicodedata.normalize("NFD", text.upper()).replace(" ", ", \n")
        docs.append((d, text))
    return docs, items


def brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = leaks.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    split = [(d, leaks.words(t)) for d, t in docs]
    return {(d, i) for d, w in split for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("limit", [leaks.BROADCAST_WINDOWS, 0])
def test_leaks_against_brute_force(spark, limit):
    docs, items = made()
    docs += [(900, None), (901, ""), (902, "curto"), (903, "x " * 100_000), (0, docs[0][1])]
    items += [(77, None), (78, ""), (79, "só três palavras"), (0, items[0][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, docs[0][1], "x")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, texto string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, i, broadcast_windows=limit).collect()}
    assert got == brute(docs, items) and got
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_near_passages(spark):
    words = [f"w{i}" for i in range(40)]
    altered = [*words]
    altered[0] = "outra"
    d = spark.createDataFrame([(1, " ".join(altered[:13]))], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words[:13]))], "item_id long, texto string")
    assert leaks.find_leaks(d, i, radius=40, similarity=0.5).first()["similaridade"] == pytest.approx(8 / 10)
    assert leaks.find_leaks(d, i).count() == 0


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(2)
    index = leaks.ItemIndex([], 13, 3, 5)
    index.fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    asked = index.fp[:200].copy()
    for k in range(200):
        for bit in rng.choice(64, k % 5, replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(bit)
    index.blocks = []
    for shift, width in leaks.block_bounds(3):
        value = (index.fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        index.blocks.append((np.uint64(shift), np.uint64((1 << width) - 1), value[order], order))
    at, of = index.candidates(asked)
    want = {(int(a), int(b)) for a in range(200) for b in range(400) if int(asked[a] ^ index.fp[b]).bit_count() <= 3}
    assert set(zip(at.tolist(), of.tolist())) == want


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["palavra"] * rng.randint(5, 60)), ["a", "a", "a", "b", "b", "c", None, "d"][i % 8]) for i in range(1600)] + [(5000, None, "a"), (5001, "", "b"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", __import__("pyspark").sql.functions.lit("x"))
    mixes = spark.createDataFrame([("m", "a", 2.0, 3), ("m", "b", 1.0, None), ("m", "c", 1.0, 2), ("m", "falta", 1.0, 2), ("n", "a", 0.5, None), ("n", "b", 0.5, None), (None, "a", 1.0, 1), ("m", "d", 0.0, 1)], "mistura string, source string, peso double, max_repeticoes int")
    shares = {(r["mistura"], r["source"]): r for r in mixtures.mixture_shares(docs, mixes).collect()}
    for (m, s), want in {("m", "a"): 0.5, ("m", "b"): 0.25, ("m", "c"): 0.25, ("n", "a"): 0.5, ("n", "b"): 0.5}.items():
        assert shares[m, s]["alvo"] == pytest.approx(want) and shares[m, s]["obtido"] == pytest.approx(want, abs=0.01)
    assert shares["m", "falta"]["obtido"] == 0 and shares["m", "falta"]["alvo"] is None and ("m", "d") not in shares
    chosen = mixtures.select_mixture(docs, mixes).collect()
    assert len({(r["mistura"], r["doc_id"]) for r in chosen}) == len(chosen)
    assert all(r["copias"] <= {"a": 3, "c": 2}.get(r["source"], 99) for r in chosen if r["mistura"] == "m")
    assert {tuple(r) for r in chosen} == {tuple(r) for r in mixtures.select_mixture(docs.repartition(5), mixes).collect()}
    assert mixtures.select_mixture(docs.limit(0), mixes).count() == 0


def test_tokens():
    assert mixtures.count_tokens(None) == 0 and mixtures.count_tokens("") == 0
    text = "Uma frase com acentuação. " * 10_000
    assert mixtures.count_tokens(text) == pytest.approx(10_000 * mixtures.count_tokens("Uma frase com acentuação. "), rel=0.2)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 1.0])
def test_turns_change_nothing(spark, similarity):
    docs, items = made(40, 8)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, texto string")
    rows = lambda n: {(r["doc_id"], r["item_id"], r["palavra"], round(r["similaridade"], 9)) for r in leaks.find_leaks(d, i, radius=12, similarity=similarity, broadcast_windows=n).collect()}
    assert rows(leaks.BROADCAST_WINDOWS) == rows(100) and rows(100)


def near_brute(docs, items, least, n=5):
    """Weighted similarity of every window of every item's length, in plain Python."""
    grams = lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    split = [(i, leaks.words(t)) for i, t in dict(items).items()]
    often = {}
    for _, w in split:
        for g in grams(w):
            often[g] = often.get(g, 0) + 1
    weight = lambda gs, own: sum(np.log1p(len(split) / (often[g] if g in own else 1)) for g in gs)
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        for i, v in split:
            own, size = grams(v), min(len(v), len(w))
            for k in range(len(w) - size + 1):
                mine = grams(w[k : k + size])
                if own and mine and weight(mine & own, own) / weight(mine | own, own) >= least:
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("limit", [leaks.BROADCAST_ITEMS, 3])
def test_near_copies_against_brute_force(spark, limit):
    """Items with a few words changed, left out and added, in longer and in shorter documents."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(50 + 7 * i))) for i in range(8)]
    docs = []
    for d in range(60):
        w = items[d % 8][1].split()
        for _ in range(d // 8 % 4):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1])] = rng.sample(vocabulary, rng.choice([0, 1]))
        around = [rng.choice(vocabulary) for _ in range(40 * (d % 3))]
        docs.append((d, " ".join([*around[: d % 30], *w, *around[d % 30 :]])))
    docs += [(90, " ".join(items[3][1].split()[3:])), (91, None), (92, ""), (93, "curto")]
    d = spark.createDataFrame([*docs, docs[0], (None, docs[0][1])], "doc_id long, text string")
    i = spark.createDataFrame([*items, items[0], (50, None), (51, "dois três")], "item_id long, texto string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.near_copies(d, i, broadcast_items=limit).collect()}
    want = near_brute([(a, b) for a, b in docs if b], [*items, (51, "dois três")], 0.8)
    assert got == want and 20 < len(got) < 61
    assert leaks.near_copies(d.limit(0), i).count() == 0 and leaks.near_copies(d, i.limit(0)).count() == 0
