"""One small invented page for each rule; expected values follow from the rule alone."""

import datetime as dt
import json

from pagesift.operators import html as hops
from pagesift.operators import photos as P
from pagesift.operators import places as PL
from pagesift.operators import reviews as RV
from pagesift.operators import search as S
from pagesift.plans.pipeline import extract_place_pages, run_pipeline
from pagesift.sources.snapshots import PAGE_SNAPSHOT_SCHEMA

NOON = dt.datetime(2025, 6, 2, 12)
HOST = "https://www.google.com"
PIC = "https://lh3.googleusercontent.com"


def snapshots(spark, *rows):
    """Rows (page_id, url, html[, keyword, region, page_no, captured_at])."""
    full = []
    for pid, url, html, *rest in rows:
        keyword, region, no, when = [*rest, *(None, None, 0, NOON)[len(rest):]]
        full.append((pid, url, html, "search" if keyword else "place", keyword, region, no, when))
    return spark.createDataFrame(full, PAGE_SNAPSHOT_SCHEMA)


def job(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "keyword string, keyword_index int")


# ---- labels and links of a search page

LINKS = [
    ('<a href="/maps/place/q1" aria-label="Tin Whistle">z</a>', "Tin Whistle", None, None, None, None),
    ("<a title='Oak & Ember | Grill | Terrace' href=/maps/place/q2></a>", "Oak & Ember", "Grill", None, None, "Terrace"),
    ('<a data-x href="/maps/place/q3"><b>Moss</b> • <i>Park</i> • Dogs welcome • Park</a>', "Moss", "Park", None, None, "Dogs welcome"),
    ('<A HREF="//www.google.com/maps/place/q4" ARIA-LABEL="Ferry Inn · 88 reviews · Hotel · 2.5 ★">x</A>', "Ferry Inn", "Hotel", 2.5, 88, None),
    ('<a aria-label=" " title="" href="/maps/place/q5?x=1#y">  </a>', f"{HOST}/maps/place/q5?x=1#y", None, None, None, None),
]


def test_listing_links(spark):
    pages = [(i, f"{HOST}/maps/search/w", f"<section><a href='/maps/dir/w'>Way</a>{link}</section>", f"w{i}", "Fen") for i, (link, *_) in enumerate(LINKS)]
    got = S.search_results(snapshots(spark, *pages), 9, job(spark, *[p[3] for p in pages])).orderBy("keyword").collect()
    assert [(r.title, r.category, r.rating, r.review_count, r.snippet, r.rank) for r in got] == [(*want, 1) for _, *want in LINKS]


def test_repeated_links_keep_the_first_and_ranks_follow_pages(spark):
    def feed(*names):
        return "".join(f'<li><a aria-label="{n.upper()}" href="/maps/place/{n}">.</a></li>' for n in names)

    pages = snapshots(spark, (31, "u?2", feed("d", "a", "e"), "w", "Fen", 2), (30, "u?1", feed("a", "b", "a", "c"), "w", "Fen", 1),
                      (32, "u?2", feed("d", "f"), "w", "Fen", 2, NOON + dt.timedelta(hours=3)))  # page 2 was captured again
    got = [(r.title, r.rank) for r in S.search_results(pages, None, job(spark, "w")).orderBy("rank").collect()]
    assert got == [("A", 1), ("B", 2), ("C", 3), ("D", 4), ("F", 5)]
    assert S.search_results(pages, -4, job(spark, "w")).count() == 1
    bare = snapshots(spark, (40, "v?1", feed("x"), "w", "Fen", None), (41, "v?2", feed("y"), "w", "Fen", None))
    assert S.search_results(bare, 9, job(spark, "w")).count() == 2


# ---- one place field at a time

RESULT = ("id string, keyword string, region string, title string, place_url string, category string, rating double, review_count bigint, snippet string, rank int, "
          "raw_label string, scraped_at timestamp, keyword_index int")


def places_of(spark, cases):
    """Place records of (html, url, result fields), in order, from one job."""
    results, pages = [], []
    for i, (html, url, kw) in enumerate(cases):
        url = HOST + url.replace("/t", f"/t{i}", 1)
        got = {"label": None, "snippet": None, "rating": None, "count": None} | kw
        results.append((f"s{i:02d}", "w", "Fen", "Listed Name", url, "Kiosk", got["rating"], got["count"], got["snippet"], 3, got["label"], NOON, 0))
        pages.append((i, url + "/", html))
    return PL.places(spark.createDataFrame(results, RESULT), PL.place_page_fields(snapshots(spark, *pages))).orderBy("search_result_id").collect()


def linked(*objects):
    return "".join(f"<script defer type='application/ld+json'>{o if isinstance(o, str) else json.dumps(o)}</script>" for o in objects)


NAMES = [
    ('<p>no head</p>', "Listed Name"), ("<title> Salt &amp; Rye - Google Maps </title>", "Salt & Rye"), ("<title> - Google Maps</title>", "Unknown place"),
    ('<meta content="Card Name" name="twitter:title"><title>other</title>', "Card Name"),
    (linked({"name": 7}, [{"x": 1}, {"geo": {}, "name": "From List"}]), "From List"), (linked('{"name": "cut', {"name": "Second Block"}), "Second Block"),
]
ADDRESSES = [
    (linked({"name": "n", "address": {"postalCode": "0042", "streetAddress": " 9  Quay "}}), {}, "9 Quay, 0042"),
    (linked({"name": "n", "address": None}) + '<meta itemprop="streetAddress" content="1 Low Rd">', {}, "1 Low Rd"),
    ('<span aria-label="Street address">77 Span Way</span><button data-item-id="Address"><i>5 Button</i> Row</button>', {}, "5 Button Row"),
    ('<div aria-label="The address here"> 3 Label Ct </div><button data-item-id=address> </button>', {}, "3 Label Ct"),
    ("<p>nothing</p>", {"snippet": "Closes at 9"}, "Closes at 9"), ("<p>nothing</p>", {}, None),
]
RATINGS = [
    (linked({"name": "n", "aggregateRating": {"ratingValue": 3, "reviewCount": "1,001"}}), {"rating": 1.0, "count": 2}, (3.0, 1001)),
    ("", {"rating": 1.5, "label": "2.5 stars · 8 reviews"}, (1.5, 8)),
    ('<meta name="description" content="4.5 stars and 60 reviews">', {"label": "12 reviews"}, (None, 12)),  # the first text that has either gives both
    ('<meta name="description" content="4.5 stars and 60 reviews">', {}, (4.5, 60)), ("<b>2 stars</b>", {}, (2.0, None)),
]
COORDINATES = [
    (linked({"geo": {"latitude": "-1.5", "longitude": 0}}), "/maps/place/t/@8,9,1z", (-1.5, 0.0)), (linked({"geo": {"latitude": 4}}), "/maps/place/t/@8,-9.25,1z", (8.0, -9.25)),
    ('<link href="https://www.google.com/maps/place/t/@3.5,4,2z" rel="CANONICAL">', "/maps/place/t/@8,9,1z", (3.5, 4.0)), ("", "/maps/place/t", None)]
CONTACTS = [
    ('<a href="TEL:+1 5">c</a><a href="mailto:a@b">m</a>', "+1 5", "TEL:+1 5"), ('<a href="#top">t</a><a href="tel:9">c</a>', "9", "#top"),
    (f'<a href="{PIC}/x">p</a><a href="{HOST}/maps">m</a><div data-website="https://fen.example/">w</div>', None, "https://fen.example/"), ("<a>plain</a>", None, None)    ]


def test_place_fields(spark):
    url = "/maps/place/t"
    cases = [(h, url, {}) for h, _ in NAMES] + [(h, url, kw) for h, kw, _ in ADDRESSES] + [(h, url, kw) for h, kw, _ in RATINGS]
    cases += [(h, u, {}) for h, u, _ in COORDINATES] + [(h, url, {}) for h, _, _ in CONTACTS]
    got = iter(places_of(spark, cases))
    assert [next(got).name for _ in NAMES] == [want for _, want in NAMES]
    assert [next(got).address for _ in ADDRESSES] == [want for _, _, want in ADDRESSES]
    rest = list(got)
    ratings, coords, contacts = rest[:len(RATINGS)], rest[len(RATINGS):len(RATINGS) + len(COORDINATES)], rest[len(RATINGS) + len(COORDINATES):]
    assert [(r.rating, r.review_count) for r in ratings] == [want for _, _, want in RATINGS]
    assert [r.coordinates and tuple(r.coordinates) for r in coords] == [want for _, _, want in COORDINATES]
    assert [(r.phone, r.website) for r in contacts] == [(p, w) for _, p, w in CONTACTS]


# ---- reviews

def reviews_of(spark, html, **kw):
    place = spark.createDataFrame([("pl", f"{HOST}/maps/place/t", f"{HOST}/maps/place/t")], "id string, source_url string, url_key string")
    return RV.reviews_from_pages(place, snapshots(spark, (1, f"{HOST}/maps/place/t", html)), **kw).orderBy("block_index").collect()


def test_blocks_come_tag_by_tag(spark):
    html = '<li data-review-id=L1>one</li><div data-review-id="D1">two<article data-review-id>three</article></div><article>no</article><li data-review-id="L2">four</li>'
    rows = reviews_of(spark, html)
    assert [(r.tag_ordinal, r.text) for r in rows] == [(0, "three"), (1, "two three"), (2, "one"), (2, "four")]
    assert [r.id for r in rows[1:]] == ["D1", "L1", "L2"] and len(rows[0].id) == 16
    assert [r.id for r in reviews_of(spark, html, limit=2)] == [rows[0].id, "D1"]


FIELDS = [
    ("<time datetime='2025-05-01'>May</time><div data-text='Calm spot'></div>", "published_at", "2025-05-01"), ("<p data-content>Loud <b>bar</b></p>", "text", "Loud bar"),
    ("<button>More</button>Plain <img src=x>words", "text", "Plain words"), ("<div data-author>Iva</div>", "author_name", "Iva"), ("<p data-review-author='Jo'></p><div data-author-name=' '>Ada</div>", "author_name", "Ada"),
    ('<a href="/u/9" data-profile-url="https://u.example/9">u</a>', "author_profile_url", "https://u.example/9"), ("<i data-rating='1,5'></i>", "rating", 15.0), ("<i data-like-count='x'></i> 7 likes", "likes", None),
    ("so good, 7 likes", "likes", 7), ("<span data-translated-text='Good'>Gut</span>", "translated_text", "Good")]


def test_review_fields(spark):
    rows = reviews_of(spark, "".join(f"<li data-review-id=k{i}>{inner}</li>" for i, (inner, *_) in enumerate(FIELDS)))
    assert [(f, r[f]) for r, (_, f, _) in zip(rows, FIELDS)] == [(f, want) for _, f, want in FIELDS]
    assert len(rows) == len(FIELDS) and all(r.photo_ids == [] for r in rows)


# ---- photos

def kept(spark, html, kind="place"):
    return P.dedup_photos(P.filter_photos(P.photo_candidates(snapshots(spark, (1, "u", html))), kind)).orderBy("source_ordinal", "pos").collect()


RULES = [
    (f'<img src="{PIC}/a" height="150" width="900">', "place", 0), (f'<img src="{PIC}/a" height="151" width="151">', "place", 1), (f'<img src="{PIC}/a=w155-h155">', "review", 0),
    (f'<img src="{PIC}/a=w155-h155" alt="the menu">', "review", 1), ('<img data-photo-url="https://cdn.example/p" width="200" height="200">', "place", 1),
    ('<img src="https://cdn.example/p" width="200" height="200">', "place", 0), (f'<img src="{PIC}/reviewer1" width="300" height="300">', "place", 0),
    (f'<a href="{PIC}/g" aria-label="user photo">g</a>', "place", 0), (f'<a href="{PIC}/g=w140">g</a><a title="t" href="{PIC}/h">h</a>', "place", 1)]


def test_photo_rules(spark):
    candidates = P.photo_candidates(snapshots(spark, *[(i, "u", html) for i, (html, *_) in enumerate(RULES)]))
    for kind in ("place", "review"):
        counts = {r.page_id: r["count"] for r in P.filter_photos(candidates, kind).groupBy("page_id").count().collect()}
        assert {i: counts.get(i, 0) for i, r in enumerate(RULES) if r[1] == kind} == {i: r[2] for i, r in enumerate(RULES) if r[1] == kind}


def test_repeated_photo_keeps_the_first_place_and_the_last_values(spark):
    a, b = (f"{PIC}/{n}" for n in "ab")
    rows = kept(spark, f'<img width=300 height=200 src="{a}"><img src="{b}" width=301 height=201><img alt="late" src="{a}" width=302 height=202><a href="{b}" title="linked">x</a>')
    assert [(r.image_url, r.source_ordinal, r.pos, r.width, r.alt_text) for r in rows] == [(a, 0, 0, 302, "late"), (b, 0, 1, None, "linked")]


def test_article_blocks_are_left_out_of_place_photos(spark):
    def img(n):
        return f'<img src="{PIC}/{n}" width="400" height="300">'

    html = f'{img("o")}<article data-review-id="1">{img("p")}</article><div data-review-id="2">{img("q")}</div><article data-review-id="">{img("r")}</article>'
    stripped = hops.strip_review_blocks(snapshots(spark, (1, "u", html)))
    assert [r.image_url[-1] for r in P.photo_candidates(stripped).orderBy("pos").collect()] == ["o", "q", "r"]


# ---- whole runs

def small_job(spark):
    search = snapshots(spark, (1, "s1", '<a href="/maps/place/t" aria-label="Tarn · Lake">t</a><a href="/maps/place/gone">g</a>', "w", "Fen"), (2, "s2", "<html></html>", "v", "Fen"))
    html = f'<title>Tarn</title><li data-review-id="r9">fine</li><li data-review-id="r8">cold</li><img src="{PIC}/t=w640-h480">'
    return job(spark, "w", "v"), search, snapshots(spark, (7, f"{HOST}/maps/place/t?hl=xx", html), (8, f"{HOST}/maps/place/never-listed", html))


def test_one_scan_of_the_place_pages(spark, tmp_path):
    small_job(spark)[2].write.parquet(str(tmp_path / "p"))
    plan = extract_place_pages(spark.read.parquet(str(tmp_path / "p")), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_dry_run_has_the_real_schemas_and_an_empty_search_completes(spark):
    keywords, search, place = small_job(spark)
    dry, real = run_pipeline(spark, keywords, search, place, dry_run=True), run_pipeline(spark, keywords, search, place)
    for name in ("search_results", "places", "reviews", "photos"):
        assert getattr(dry, name).columns == getattr(real, name).columns and getattr(dry, name).count() == 0
    state = {r.keyword: (r.completed, r.next_place_index) for r in real.progress.filter("place_id is null").collect()}
    assert state == {"w": (True, 2), "v": (True, 0)}
    assert tuple(real.summary.first()) == (2, 1, 2, 1) and tuple(dry.summary.first()) == (0, 0, 0, 0)
