"""6. URL filters: logistic regression on hashed character n-grams of host and path.

A URL is lower-cased and split into host (without scheme, user and port) and path (with query). The 3- to 5-grams of
`^host$` and `^path$`, hashed apart into 2**BITS buckets, are the features; a feature weighs its count over the root of
the URL's feature count. Training takes a small labelled URL table (LABELLED, or rows given) on the driver; its size
does not depend on the table that is scored. Scores are sparse dot products over whole Arrow batches.

Defined results: a null, empty or blank URL has a null score and is not kept. Repeated rows and null ids are scored like any others.
Other columns, long ones included, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm._shared import table
from lattice.llm._text import _buffer, as_text, mix
from lattice.llm.quality import _sums, train

BITS, GRAMS, THRESHOLD, EPOCHS = 16, (3, 4, 5), 0.5, 40

#: URLs to reject, and URLs to keep: written by hand, one example of many kinds.
REJECT = """
http://casino-royal.example/slots best-casino.example/bonus?ref=a www.online-casino.example/win m.casino-club.example/en/11 http://win-casino.example/jackpot
https://casino-win-big.example/play https://mega-win.example/casino http://poker-win.example/table https://slots-win.example/free https://big-win-lottery.example/claim
https://free-bets-now.example/odds http://sport-bets.example/tips?utm=x https://best-bets.example/free http://free-spins.example/bets https://m.bets-online.example/en/7
http://cheap-pills-online.example/buy https://pills-store.example/cheap www.cheap-meds.example/pills http://buy-pills.example/en/44.html https://diet-pills.example/sale
http://cheap-viagra.example/order https://cheap-watches.example/replica http://cheap-loans.example/apply https://payday-loans.example/fast http://cheap-tickets-scam.example/win
http://ads-tracker.example/click?id=9 https://ads-server.example/banner https://track-ads.example/pixel.gif http://click-track.example/redirect https://popup-ads.example/show
https://ad-track.example/collect http://adserver.example/ads?slot=3 https://tracking-pixel.example/ads http://banner-ads.example/en/31 https://blog.ads-network.example/track
https://adult-movies.example/watch http://adult-toys.example/shop https://adult-dating.example/join http://xxx-videos.example/adult https://adult-cams.example/live http://hot-singles.example/dating https://porn-tube.example/watch http://sex-chat.example/en/12
https://free-iphone.example/winner http://claim-prize.example/free https://crypto-doubler.example/earn http://earn-money-fast.example/home https://miracle-cure.example/buy-now
http://seo-backlinks.example/cheap https://buy-followers.example/cheap http://essay-writing-cheap.example/order https://replica-bags.example/outlet http://download-crack.example/keygen
https://warez-full.example/torrent http://free-streaming-hd.example/movie https://account-verify-login.example/bank http://secure-update-paypa1.example/login https://spam-links.example/en/5
"""
KEEP = """
https://www.university.example/en/library/catalogue https://openlibrary.example/books/1234 http://blog.gardening.example/2019/roses https://news.example/world/article-55.html https://docs.software.example/guide/install
https://museum.example/collections/stone-age http://www.weather.example/forecast/de https://recipes.example/bread/rye https://en.encyclopedia.example/wiki/Tracking_stations https://cityhall.example/en/services/861
http://m.history.example/en/4410.html https://blog.teacher.example/es/8110/ https://www.mountains.example/fr/302?page=2&ref=x https://anthology.example/poems/22 http://www.therapist.example/en/3456?utm_source=feed
https://forum.cooking.example/thread/998 https://science.example/papers/astro/17 http://hospital.example/patients/visiting https://www.orchestra.example/season/2020 https://railways.example/timetable?from=a
https://m.library.example/en/7431#top https://www.inthation.example/de/5529/ http://blog.thering.example/en/1277.html https://theston.example/fr/9044?page=2&ref=x https://tionan.example/es/365#top
https://thand.example/en/2098 http://www.erent.example/de/4871.html https://ouster.example/en/6612?utm_source=feed http://m.ontheha.example/es/7203/ https://www.reathe.example/fr/118
https://standing.example/en/77 https://www.therein.example/en/6001.html https://blog.whandle.example/de/9000?utm_source=feed http://sheland.example/fr/43#top https://estion.example/es/5005?page=2&ref=x
https://journal.example/issue/12/page/4 http://archive.example/items/letters-1890 https://parliament.example/debates/2011-03-02 https://www.botany.example/species/quercus https://maps.example/region/north
https://school.example/timetable/monday http://choir.example/concerts https://astronomy.example/observing/winter https://kids.example/stories/fox https://chess.example/openings/italian
https://www.harbour.example/ships/arrivals https://cinema.example/programme http://theatre.example/plays/winter-tale https://co-op.example/members/news https://bank.example/branches
https://trackandfield.example/results/2018 https://windpower.example/projects http://adsorption-lab.example/methods https://freedom-of-press.example/reports https://pillar.example/architecture
"""


#: Paths that say nothing: every host of the table is seen with some of them, whatever its label.
NEUTRAL = "/en/4711 /de/80.html /fr/2290?utm_source=feed /es/17/ /en/593#top /de/6604?page=2&ref=x /index.html /a/b/c /fr/31.html /en/77?page=9 /2020/01/post /es/8085#top".split()


def labelled() -> list[tuple[str, int]]:
    """(url, 1 to keep or 0 to reject): the URLs above, and their hosts with neutral paths."""
    out = []
    for label, urls in ((0, REJECT.split()), (1, KEEP.split())):
        for i, url in enumerate(urls):
            host = split_url(url)[0].strip("^$")
            out += [(url, label), *((f"http://{host}{NEUTRAL[(i * 5 + j * 7) % len(NEUTRAL)]}", label) for j in range(4))]
    return out


def _grams(texts: pa.Array, salt: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's character n-grams (over bytes), and the text that each is of."""
    raw, starts = _buffer(as_text(texts))
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    values, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(raw) < n:
                continue
            size = len(raw) - n + 1
            h = np.full(size, np.uint64(salt * 131 + n))
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + raw[i : i + size].astype(np.uint64) + np.uint64(1)
            inside = of[:size] == of[n - 1 :]
            values.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int32))
            owners.append(of[:size][inside])
    return (np.concatenate(values), np.concatenate(owners)) if values else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def features(hosts: pa.Array, paths: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) by URL."""
    (a, of_a), (b, of_b) = _grams(hosts, 1, bits), _grams(paths, 2, bits)
    of, buckets = np.concatenate([of_a, of_b]), np.concatenate([a, b])
    order = np.argsort(of, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(hosts)))])


def split_url(url: str) -> tuple[str, str]:
    """The same as the Spark expressions of `parts`, for the training table."""
    rest = url.strip().lower().split("://", 1)[-1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    return f"^{rest[:end].rsplit('@', 1)[-1].split(':', 1)[0]}$", f"^{rest[end:]}$"


def fit(rows: list[tuple[str, int]] | None = None, bits: int = BITS) -> np.ndarray:
    """Weights from (url, label) rows, by default the labelled table; rows are taken in a fixed shuffle."""
    rows = labelled() if rows is None else rows
    rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    if not rows:
        return np.zeros((1 << bits) + 1, np.float32)
    halves = [split_url(u) for u, _ in rows]
    buckets, ends = features(pa.array([h for h, _ in halves]), pa.array([p for _, p in halves]), bits)
    return train([(buckets[ends[i] : ends[i + 1]], y) for i, (_, y) in enumerate(rows)], bits, EPOCHS)


def classify(pages: DataFrame, rows: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(page_id, url, url_score, is_kept) of every row; url_score is the probability that the URL is one to keep."""
    sent = pages.sparkSession.sparkContext.broadcast(fit(rows, bits))
    whole = F.lower(F.trim(F.col("url").cast("string")))
    rest = F.regexp_replace(whole, r"^[^/?#]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), "^.*@", ""), ":.*$", "")
    parts = pages.select("page_id", "url", F.concat(F.lit("^"), host, F.lit("$")).alias("host"), F.concat(F.lit("^"), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), F.lit("$")).alias("path"), (F.coalesce(F.length(whole), F.lit(0)) > 0).alias("some"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            buckets, ends = features(batch.column(2), batch.column(3), bits)
            logit = _sums(w[buckets], ends) / np.sqrt(np.maximum(np.diff(ends), 1)) + w[-1]
            score = np.round(1 / (1 + np.exp(-np.clip(logit, -35, 35))), 6)
            some = batch.column(4).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, mask=~some), pa.array((score >= threshold) & some)], names=["page_id", "url", "url_score", "is_kept"])

    kinds = dict(pages.dtypes)
    return parts.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, url_score double, is_kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "pages"))
