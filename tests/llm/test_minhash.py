import random
import re

import numpy as np
import pytest

from lattice.llm import minhash_dedup as m
from lattice.llm._text import ngrams, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def shingles(text, k=3):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups_by_brute_force(rows, threshold):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and len(x & y) / len(x | y) >= threshold for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def got(df):
    return {r.doc_id: r.group_id for r in df.collect()}


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 700):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = a.copy()
            k = n // 4
            b[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            s = m.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            errors.append((s[0] == s[1]).mean() - (n - k) / (n + k))
        assert abs(np.mean(errors)) < 0.03


def test_signature_is_a_minimum_over_permutations():
    """Against the definition: each element puts level + fraction into the slot its permutation has at that level."""
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 7, dtype=np.uint64)
    whole = m.superminhash(elements, np.array([0, 7]), 16)[0]
    singles = np.stack([m.superminhash(elements[i : i + 1], np.array([0, 1]), 16)[0] for i in range(7)])
    assert (whole == singles.min(axis=0)).all()
    for row in singles:
        assert sorted(int(x) >> 32 for x in row) == list(range(16))  # one slot a level: a permutation


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = words(rng, rng.choice([8, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    shared = words(rng, 60)
    rows += [(len(rows) + i, words(rng, 200) + " " + shared) for i in range(20)]
    expected = groups_by_brute_force(rows, m.THRESHOLD)
    found = got(m.near_duplicate_groups(frame(spark, rows)))
    wrong = [i for i in expected if expected[i] != found[i]]
    assert len(wrong) <= 0.02 * len(expected), wrong


def test_many_variants_of_one_text(spark):
    rng = random.Random(4)
    base = words(rng, 120).split()
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, words(rng, 100)) for i in range(50)]
    found = got(m.near_duplicate_groups(frame(spark, rows)))
    assert {found[i] for i in range(300)} == {0}
    assert all(found[1000 + i] == 1000 + i for i in range(50))


def test_nulls_empties_ties_repeats_and_clashing_columns(spark):
    long = words(random.Random(5), 60_000)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, None), (5, "one"), (6, "One!"), (7, "one two"), (None, "one"), (8, long), (9, long + " end"), (5, "one"), (10, "!!!")]
    df = frame(spark, rows).selectExpr("*", "1 as group_id", "2 as head", "3 as keys", "4 as src", "5 as is_kept")
    found = got(m.near_duplicate_groups(df))
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10}
    kept = sorted((r.doc_id is None, r.doc_id) for r in m.drop_near_duplicates(df).collect())
    assert kept == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8, 10)] + [(True, None)]
    assert m.drop_near_duplicates(df).columns == df.columns


def test_empty_table(spark):
    assert m.near_duplicate_groups(frame(spark, [])).count() == 0
    assert m.drop_near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets_in_parts(spark):
    """Every bucket of more than 16 members goes through parts, leaders and tiles; the groups are those of brute force."""
    rng = random.Random(6)
    base = words(rng, 120).split()
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append((i, " ".join(copy)))
    half = base[:70]
    rows += [(200 + i, " ".join([*half, *words(rng, 110).split()])) for i in range(60)]  # share a part, but are no copies
    rows += [(400 + i, " ".join([*half, *words(rng, 3).split()])) for i in range(40)]
    expected = groups_by_brute_force(rows, m.THRESHOLD)
    found = got(m.near_duplicate_groups(frame(spark, rows), bucket_rows=16))
    assert sum(expected[i] != found[i] for i in expected) <= 0.02 * len(expected)
    assert found == got(m.near_duplicate_groups(frame(spark, rows)))


def test_tiles_join_different_components_only():
    import pyarrow as pa

    raw = np.random.default_rng(1).integers(0, 256, (3, 128), dtype=np.uint8)
    table = lambda ids, at, group: pa.table({"doc_id": ids, "slots": [raw[i].tobytes() for i in at], "component": group})
    out = m._tile(table([7, 8], [0, 1], [7, 7]), table([1, 2, 3, 4], [0, 0, 1, 2], [1, 1, 7, 4]), 0.5, 3.0).to_pylist()
    assert [(r["src"], r["dst"], r["sure"]) for r in out] == [(1, 7, True)]


@pytest.mark.parametrize("text,n", [("", 0), ("a b", 2), ("a,b;c é", 4), ("我喜欢。苹果", 5), ("«été»… “x”", 2), ("ไทย ab", 4), ("ひ123か", 3), ("한국 말", 2), ("𠀀𠀁a", 3), ("a\u00a0b\u3000c", 3), ("１２、３", 2)])
def test_words(text, n):
    import pyarrow as pa

    hashes, offsets = word_hashes(pa.array([text, "x y z w"]))
    assert offsets.tolist() == [0, n, n + 4]
    grams, ends = ngrams(hashes, offsets, 3, pad=True)
    assert ends.tolist() == [0, max(n - 2, min(n, 1)), max(n - 2, min(n, 1)) + 2]
