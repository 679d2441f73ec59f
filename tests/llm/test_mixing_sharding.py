import itertools
import random
from collections import Counter, defaultdict

from lattice.llm import mixing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], SCHEMA)


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, "x" * rng.randint(1, 400), rng.choice(["en", "en", "en", "de", "fr"]), "s0" if rng.random() < 0.5 else rng.choice(["s1", "s2", "s3"])) for i in range(n)]


def cost_of(tokens, flow, passes):
    sent = defaultdict(int)
    for (p, _), n in flow.items():
        sent[p] += n
    total = 0
    for p, n in sent.items():
        for k in range(passes):
            take = min(tokens[p], max(0, n - k * tokens[p]))
            total += take * (k * (k + 1) // 2)
    return sum(sent.values()), total


def test_flow_is_optimal_by_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        sources = ["a", "b"]
        patterns = [("a",), ("b",), ("a", "b")]
        tokens = {p: rng.randint(1, 3) for p in patterns}
        quotas = {s: rng.randint(0, 5) for s in sources}
        flow = mixing.route(tokens, quotas, passes=2)
        assert all(sum(n for (_, s2), n in flow.items() if s2 == s) <= quotas[s] for s in sources)
        links = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in itertools.product(range(6), repeat=len(links)):
            trial = {link: n for link, n in zip(links, amounts) if n}
            if all(sum(n for (_, s2), n in trial.items() if s2 == s) <= quotas[s] for s in sources) and all(sum(n for (p2, _), n in trial.items() if p2 == p) <= 2 * tokens[p] for p in patterns):
                most, cost = cost_of(tokens, trial, 2)
                if best is None or (-most, cost) < best:
                    best = (-most, cost)
        most, cost = cost_of(tokens, flow, 2)
        assert (-most, cost) == best


def test_selection_by_brute_force(spark):
    rows = corpus(1200)
    df = frame(spark, rows)
    weights = {"s0": 0.2, "s1": 0.5, "s2": 0.2, "lang:de": 0.1}
    made = mixing.plan(df, mixing.memberships(), weights)
    out = {r.doc_id: (r.repeats, r.tokens) for r in mixing.repeats(df, weights=weights).collect()}
    assert len(out) == len(rows)
    import hashlib

    def draw(i):
        return int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16)

    by = defaultdict(list)
    for i, t, la, s in rows:
        by[tuple(sorted([s, f"lang:{la}"]))].append((draw(i), i, -(-len(t) // 4)))
    sent = defaultdict(int)
    for (p, _), n in made.flow.items():
        sent[p] += n
    for p, docs in by.items():
        total = sum(n for *_, n in docs)
        whole, rest = divmod(sent[p], total)
        upto = 0
        for _, i, n in sorted(docs):
            assert out[i] == (whole + (1 if upto < rest else 0), n), (p, i)
            upto += n


def test_mixture_meets_its_targets(spark):
    df = frame(spark, corpus(4000, 5))
    weights = {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}
    got = defaultdict(int)
    for r in mixing.draw(df, weights=weights).collect():
        got[r.source] += -(-len(r.text) // 4)
    total = sum(got.values())
    assert all(abs(n / total - 0.25) < 0.01 for n in got.values())


def test_mixing_edge_cases(spark):
    rows = [(1, "abcd" * 10, "en", "a"), (1, "abcd" * 10, "en", "a"), (2, "", "en", "a"), (3, None, "en", "a"), (None, "abcd", "en", "b"), (4, "z" * 100_000, "de", None), (5, "no source", None, None)]
    df = frame(spark, rows).selectExpr("*", "1 as pattern", "2 as tokens", "3 as draw", "4 as repeats", "5 as cell")
    out = mixing.repeats(df).collect()
    assert len(out) == len(rows)
    assert all(r.repeats == 0 for r in out if r.doc_id in (2, 3, 5))
    drawn = mixing.draw(df, keep_unmatched=True)
    assert drawn.columns == df.columns
    assert any(r.doc_id == 5 for r in drawn.collect())
    empty = frame(spark, [])
    assert mixing.repeats(empty).count() == 0 and mixing.draw(empty).count() == 0


def test_too_many_patterns_raise(spark):
    import pytest

    with pytest.raises(ValueError):
        mixing.plan(frame(spark, corpus(50)), mixing.memberships(), max_patterns=2)


def assign(spark, rows, **options):
    return sharding.assign_shards(frame(spark, rows), **options).collect()


def test_sharding_by_brute_force(spark):
    import hashlib

    rows = corpus(1500, 7)
    draw = {i: hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest() for i, *_ in rows}
    by = defaultdict(list)
    for i, _, _, s in rows:
        by[s].append(i)
    order = []
    for s, ids in by.items():
        for rank, i in enumerate(sorted(ids, key=lambda i: (draw[i], i))):
            order.append(((rank + 0.5) / len(ids), s, draw[i], i))
    expected = {i: at * 10 // len(rows) for at, (*_, i) in enumerate(sorted(order))}
    for cell_rows in (50, 100_000):
        out = assign(spark, rows, shards=10, cell_rows=cell_rows)
        assert {r.doc_id: r.shard for r in out} == expected
        places = defaultdict(list)
        for r in out:
            places[r.shard].append(r.place)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_every_shard_matches_the_mixture(spark):
    rows = corpus(2000, 8)
    share = Counter(s for *_, s in rows)
    out = assign(spark, rows, shards=8)
    for shard in range(8):
        mine = Counter(r.source for r in out if r.shard == shard)
        assert all(abs(mine[s] - share[s] / 8) <= 2 for s in share)


def test_sharding_edge_cases(spark):
    rows = [(1, "a", "en", "a"), (1, "a", "en", "a"), (None, "b", "en", None), (2, None, None, None), (3, "c" * 100_000, "en", "a")]
    df = frame(spark, rows).selectExpr("*", "1 as shard", "2 as draw", "3 as n", "4 as cell", "5 as rank")
    out = sharding.assign_shards(df, shards=3).collect()
    assert len(out) == 5 and {r.shard for r in out} <= {0, 1, 2}
    assert len({(r.shard, r.place) for r in out}) == 5
    assert len(assign(spark, rows, shards=50)) == 5
    assert assign(spark, []) == []
