import random

import pyarrow as pa

from lattice.llm import license_scan, quality, url_filter
from lattice.llm.license_rules import RULES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def good(rng):
    return " ".join(rng.choice(["the river", "and a house", "was built", "in spring", "by people", "with care"]) + rng.choice([",", "", "."]) for _ in range(rng.randint(5, 60)))


def bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(rng.randint(5, 60)))
    if kind == 1:
        return " ".join([rng.choice(["of", "here", "xyz"])] * rng.randint(8, 60))
    return " ".join(rng.choice(["the", "house"]) + rng.choice(["$$$", "%%%"]) for _ in range(rng.randint(5, 60)))


def labelled(spark, n, seed):
    rng = random.Random(seed)
    y = [int(rng.random() < 0.7) for _ in range(n)]
    return frame(spark, [(i, (good if v else bad)(rng)) for i, v in enumerate(y)]), spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id bigint, quality int, toxic int"), y


def test_held_out_accuracy(spark):
    docs, labels, y = labelled(spark, 1200, 1)
    out = {r.doc_id: r.is_kept for r in quality.classify(docs, labels.where("doc_id < 800")).collect()}
    right = sum(out[i] == bool(y[i]) for i in range(800, 1200))
    assert right >= 0.97 * 400


def test_scores_equal_a_plain_loop(spark):
    docs, labels, _ = labelled(spark, 60, 2)
    w = quality.fit(docs, labels)
    import numpy as np

    for r in docs.select("text", quality.score(docs["text"], w, spark).alias("quality_score")).collect():
        buckets, ends = quality.features(pa.array([r.text]))
        logit = sum(float(w[b]) for b in buckets) / np.sqrt(len(buckets)) + w[-1]
        assert abs(r.quality_score - 1 / (1 + np.exp(-logit))) < 2e-6
        assert ends[-1] == len(buckets)


def test_training_is_bounded_and_repeatable(spark):
    docs, labels, _ = labelled(spark, 300, 3)
    a, b = quality.fit(docs.repartition(3), labels, max_rows=50), quality.fit(docs.repartition(5), labels, max_rows=50)
    assert (a == b).all() and (a != quality.fit(docs, labels, max_rows=300)).any()


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the river was built"), (4, "the river was built"), (None, "the house"), (5, "word " * 50_000)]
    df = frame(spark, rows).selectExpr("*", "1 as quality_score", "2 as is_kept", "3 as label_id", "4 as quality")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.classify(df, none).collect()
    assert len(out) == 7
    assert all((r.quality_score == 0 and not r.is_kept) if r.doc_id in (1, 2, 3) else (r.quality_score == 0.5 and r.is_kept) for r in out)
    kept = quality.reject(df, none)
    assert kept.columns == df.columns and kept.count() == 4
    odd = spark.createDataFrame([(None, 1, 0), (4, None, 0), (4, 1, 0), (4, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(df, odd).count() == 7
    assert quality.classify(frame(spark, []), none).count() == 0


def test_url_held_out():
    import numpy as np

    rows = url_filter.labelled()
    hosts = sorted({url_filter.split_url(u)[0] for u, _ in rows})
    held = set(random.Random(4).sample(hosts, len(hosts) // 5))
    w = url_filter.fit([r for r in rows if url_filter.split_url(r[0])[0] not in held])
    test = [r for r in rows if url_filter.split_url(r[0])[0] in held]
    halves = [url_filter.split_url(u) for u, _ in test]
    buckets, ends = url_filter.features(pa.array([h for h, _ in halves]), pa.array([p for _, p in halves]))
    logit = quality._sums(w[buckets], ends) / np.sqrt(np.diff(ends)) + w[-1]
    assert np.mean((logit >= 0) == np.array([y for _, y in test])) >= 0.8


def test_url_scores_equal_a_plain_loop(spark):
    import numpy as np

    urls = ["https://www.Casino-Win.example/en/4?x=1#y", "http://user@library.example:8080/books", "library.example", "HTTPS://a.example?q", "ftp://x/y"]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    w = url_filter.fit()
    for r in url_filter.classify(df).collect():
        h, p = url_filter.split_url(r.url)
        buckets, _ = url_filter.features(pa.array([h]), pa.array([p]))
        logit = sum(float(w[b]) for b in buckets) / np.sqrt(len(buckets)) + w[-1]
        assert abs(r.url_score - 1 / (1 + np.exp(-logit))) < 1e-5, r.url
    kept = {r.page_id: r.is_kept for r in url_filter.classify(df).collect()}
    assert not kept[0] and kept[1]


def test_url_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "http://a.example/", ""), (3, "  ", ""), (4, "http://b.example/" + "x" * 100_000, ""), (4, "q", "")], "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as some", "4 as url_score")
    out = url_filter.classify(df).collect()
    assert len(out) == 6
    assert all(r.url_score is None and not r.is_kept for r in out if r.page_id in (1, 2, 3))
    assert url_filter.classify(df.limit(0)).count() == 0


def test_rules_are_many_and_their_keywords_sound():
    rules = license_scan.rules()
    assert len(rules) >= 200
    examples = {"Licensed under the Apache License, Version 2.0": "Apache-2.0", "gnu general public license v3": "GPL-3.0", "the 3-clause  BSD\nlicense": "BSD-3-Clause", "CC BY-SA 4.0": "CC-BY-SA-4.0", "SPDX-License-Identifier: MIT": "MIT"}
    scanner = license_scan.Scanner(rules)
    for text, name in examples.items():
        assert name in [r.license_id for *_, r in scanner.scan(text)], text


def by_brute_force(text):
    """All regexes, no prefilter; a detection stays unless one that comes before it in the order holds it."""
    import re

    found = [(m.start(), m.end(), r) for r in license_scan.rules() for m in re.finditer(r.pattern, text, re.IGNORECASE)]
    found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].number))
    kept = []
    for d in found:
        if not [k for k in kept if k[0] <= d[0] and d[1] <= k[1]]:
            kept.append(d)
    return sorted((s, e, r.number) for s, e, r in kept)


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    bits = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3", "https://www.gnu.org/licenses/gpl-3.0.html", "All rights reserved", "CC BY-NC 4.0", "cc-by-4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "mit", "license", "Copyright 2020 X. All rights reserved.", "lesser general public license v2.1", "Mozilla Public License 2.0", "gplv3", "zlib license"]
    texts = [" ".join(rng.choice([*bits, "word", "\n", "the"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    out = {}
    for r in license_scan.licenses(frame(spark, list(enumerate(texts)))).collect():
        assert texts[r.doc_id][r.start : r.end] == r.matched
        out.setdefault(r.doc_id, []).append((r.start, r.end, r.rule))
    for i, t in enumerate(texts):
        assert sorted(out.get(i, [])) == by_brute_force(t), t


def test_wrapped_license_text():
    """The third clause as license files wrap it, with a holder's name that has a full stop."""
    text = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of Acme Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    found = license_scan.Scanner(license_scan.rules()).scan(text)
    assert [r.license_id for *_, r in found] == ["BSD-Source-Code", "BSD-3-Clause"]


def test_suppression_equals_its_definition():
    rng = random.Random(7)
    rules = license_scan.rules()
    for _ in range(400):
        found = [(a, a + rng.randint(1, 12), rng.choice(rules)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 25)))]
        taken = []
        for d in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].number)):
            if not any(t[0] <= d[0] and d[1] <= t[1] for t in taken):
                taken.append(d)
        assert license_scan.suppress(found) == sorted(taken, key=lambda d: (d[0], d[1], d[2].number))
    many = [(2 * i, 2 * i + 1, rules[0]) for i in range(200_000)]
    assert license_scan.suppress(many) == many


def test_keywords_are_in_every_match():
    import re

    for rule in license_scan.rules():
        literal = re.sub(r"\\([.\-/()])", r"\1", rule.pattern.lower()).replace(r"\s+", " ").replace("(/libpng)?", "")
        assert rule.keyword in literal and " " not in rule.keyword, rule
    assert RULES.count("|") > 400


def test_license_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "nothing"), (None, "MIT License"), (4, "MIT License MIT License"), (4, "MIT License MIT License"), (5, "x " * 100_000 + "zlib license")]
    df = frame(spark, rows).selectExpr("*", "1 as start", "2 as rule", "3 as matched")
    out = license_scan.licenses(df).collect()
    assert sorted((r.doc_id or 0, r.start) for r in out) == [(0, 0), (4, 0), (4, 0), (4, 12), (4, 12), (5, 200_000)]
    assert license_scan.licenses(df.limit(0)).count() == 0
