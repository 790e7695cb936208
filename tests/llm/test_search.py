import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tenderlens.llm import decontamination, html_extraction, topk
from tests.llm.common import ALNUM, SCHEMA, clashing, fold, odd_documents, prose


def best_by_force(rows, k=5, every=50):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
        monkeypatch.setattr(topk, "QUERY_ROWS", 3)
        monkeypatch.setattr(topk, "RESOLVED", 1)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=11).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 11) for i in range(400, 470)] + [
        (470, None),
        (500, [None] * 11),
        (550, [float("nan")] + [0.1] * 10),
        (600, [float("inf")] * 11),
        (None, [0.1] * 11),
        (650, [0.25] * 4),
        (651, [1.0] * 4),
    ]
    out = topk.top_k(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 50 == 0).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in out) == best_by_force(rows)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(6)
    x, queries = rng.integers(-100, 100, (50, 9)), rng.integers(-100, 100, (4, 9))
    lists = topk.SortedLists(np.arange(50), x)
    for q in queries:
        reading, exact = topk.Reading(lists, q.astype(float)), x @ q
        for share in (0.02, 0.1, 0.3, 0.7, 1.0):
            lower, upper = reading.advance(share)
            assert (lower <= exact).all() and (exact <= upper).all() and (reading.depth <= 50).all()
        assert reading.ended and (lower == exact).all() and (upper == exact).all()


def test_reading_stops_early_where_bounds_close():
    """A few rows stand out in the lists that matter: the rest is out long before the lists end, and no score is lost."""
    rng = np.random.default_rng(7)
    x = rng.integers(-40, 40, (3000, 16))
    x[:20] += 400
    queries = rng.integers(20, 60, (8, 16))
    lists = topk.SortedLists(np.arange(3000), x)
    for number, ids, scores in lists.best(np.arange(5000, 5008), queries, 5):
        exact = x @ queries[number - 5000]
        first = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == first.tolist() and scores.tolist() == exact[first].tolist()
    assert lists.closed_early == 8 and lists.read_entries < 0.3 * lists.entries


def test_top_k_counts_repeated_rows_one_by_one(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0]), (50, [1.0, 1.0]), (50, [3.0, 3.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    by_rank = [(r.vec_id, r.score) for r in sorted(out, key=lambda r: (r.rank, -r.score)) if r.query_id == 50]
    scores = sorted(((256 * 256 * (a + b), i) for i, (a, b) in [(1, (1, 2)), (1, (1, 2)), (2, (2, 2))]), key=lambda x: (-x[0], x[1]))
    assert {s for _, s in by_rank} <= {s for s, _ in scores} | {3 * s for s, _ in scores} and all(i != 50 for i, _ in by_rank)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


ITEMS = [
    ("a", prose(50, 40)),
    ("b", prose(51, 13)),
    ("c", "Two Words"),
    ("d", None),
    ("e", "  "),
    ("f", prose(50, 20) + " " + prose(52, 9)),
    ("a", prose(53, 15)),
    (None, prose(54, 20)),
    ("g", "the the the the the the the the the the the the the the the"),
]


def hits_by_force(rows, items, k=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t))
        if w:
            n = min(k, len(w))
            for a in range(len(w) - n + 1):
                windows[tuple(w[a : a + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t, *_ in rows:
        w = ALNUM.findall(fold(t))
        hit, seen = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit[a : a + n] = [True] * n
                    seen |= found
        h = sum(hit)
        out.append((i, len(w), h, len(seen), hashlib.sha256(",".join(sorted(seen - {None})).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return Counter(out)


def contaminated_rows():
    item = ITEMS[0][1]
    rows = odd_documents()
    rows += [(900 + i, f"{prose(900 + i, 30 * i)}, {' '.join(item.split()[i : i + 13 + i]).upper()}! {prose(950 + i, 20)}", "en", "a", 1) for i in range(10)]
    return rows + [
        (920, "these two words here", "en", "a", 1),
        (921, "the " * 40, "en", "a", 1),
        (922, prose(54, 20), "en", "a", 1),
        (923, prose(53, 15), "en", "a", 1),
    ]


@pytest.mark.parametrize("max_words", [200_000, 400, 60])
def test_decontamination_equals_brute_force(spark, max_words):
    """Also when the benchmark has too many words for one automaton."""
    rows = contaminated_rows()
    out = decontamination.decontaminate(
        clashing(spark.createDataFrame(rows, SCHEMA)),
        spark.createDataFrame(ITEMS, "item_id string, text string"),
        max_words=max_words,
    ).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == hits_by_force(rows, ITEMS)
    for r in out:
        assert (r.clean_text == r.text) if not r.n_hit else (not r.contaminated or len(ALNUM.findall(fold(r.clean_text))) <= r.n_words - r.n_hit + 1)


@pytest.mark.parametrize("max_words", [200_000, 60])
def test_items_without_id_contaminate(spark, max_words):
    """As in the query's SQL: they mark words and count as one item, whose id is in no hash."""
    items = [*ITEMS, (None, prose(55, 15)), (None, None)]
    rows = [*contaminated_rows(), (930, f"{prose(54, 20)} {prose(55, 15)}", "en", "a", 1), (931, f"{prose(54, 20)} {ITEMS[1][1]}", "en", "a", 1)]
    found = decontamination.decontaminate(
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(items, "item_id string, text string"),
        max_words=max_words,
    ).collect()
    out = {r.doc_id: r for r in found}
    none, b = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"b").hexdigest()
    got = {i: (out[i].n_words, out[i].n_hit, out[i].n_items, out[i].items_sha256, out[i].item_ids, out[i].contaminated) for i in (922, 930, 931)}
    assert got == {922: (20, 20, 1, none, [], True), 930: (35, 35, 1, none, [], True), 931: (33, 33, 2, b, ["b"], True)}
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == hits_by_force(rows, items)


def test_decontamination_leaves_clashing_columns_alone(spark):
    docs = clashing(spark.createDataFrame(contaminated_rows(), SCHEMA))
    out = decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id string, text string"), prefix="__dec_", clean=False)
    assert out.columns[: len(docs.columns)] == docs.columns and out.where("contaminated <> 'kept' or n_words <> 'kept'").count() == 0
    assert out.where("__dec_contaminated").count() == sum(r[-1] for r in hits_by_force(contaminated_rows(), ITEMS).elements())


def test_decontamination_of_and_by_nothing(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id string, text string")
    assert decontamination.decontaminate(docs, items).collect() == []
    out = decontamination.decontaminate(spark.createDataFrame(odd_documents(), SCHEMA), items).collect()
    assert len(out) == len(odd_documents()) and not any(r.n_hit or r.contaminated for r in out)


PAGES = [
    (
        "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p><b>First,\n  part.<br><p>Second &#233; one.</article><footer>&copy;</footer></body></html>",
        "Head & line\nFirst, part.\nSecond é one.",
    ),
    (
        "<body><header>Site</header><div class='cookie-notice'>We use cookies, yes, we do.</div><main><h1>T</h1><p>One, two.</p><form><p>Your name</p></form><section class='comments'><p>A reader, with a long comment, says so.</p></section></main><aside>side</aside></body>",
        "T\nOne, two.",
    ),
    (
        "<div id=page><div class=menu><ul><li><a>x</a><li><a>y</a></ul></div><div class=story><h2>Title</h2><p>A long sentence, with commas. And more text here.</p><p>ok</p><div class=ad>Buy, now, this.</div></div><div class=sidebar><p>Other, things.</p></div></div>",
        "Title\nA long sentence, with commas. And more text here.\nok",
    ),
    ("<article><p>a &lt;b&gt; &amp;amp; c</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>d e</p></article>", "a <b> &amp; c\nd e"),
    (
        "<body><div class='content with-sidebar'><article><div class='article-header'><h1>H</h1></div><p>Some, text.</p></article></div></body>",
        "H\nSome, text.",
    ),
    ("", ""), (None, ""), ("plain text only", "plain text only"), ("<<<>>> <p", "<<<>>> <p"), ("<article><p>unclosed", "unclosed"), ("</p></div><article>x</article>", "x"),
]


def test_main_text_of_pages(spark):
    rows = [(i, "u", h, "kept") for i, (h, _) in enumerate(PAGES)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, size string")).orderBy("page_id").collect()
    assert [r.text for r in out] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) and r.size == "kept" for r in out)


LONG = " ".join(f"Sentence {i} of the body, long enough, ends here." for i in range(200))
WHOLE_ARTICLES = [
    (f"<body><nav>Menu</nav><article><h1>Title</h1><p class=lead>A lead.</p><div class=body><p>{LONG}</p></div></article></body>", f"Title\nA lead.\n{LONG}"),
    (f"<main><h1>Title</h1><article><div class=body><p>{LONG}</p></div></article></main>", f"Title\n{LONG}"),
    (f"<div class=page><div class=a><p>{LONG}</p></div><div class=a><p>{LONG[:300]}</p></div></div>", f"{LONG}\n{LONG[:300]}"),
    (
        f"<article><h2 id=notice>Notice</h2><p>{LONG}</p><section id=related-work><h2>Related work</h2><p>Others, too.</p></section></article>",
        f"Notice\n{LONG}\nRelated work\nOthers, too.",
    ),
    (f"<body><nav>Menu</nav><article title='The hidden truth'><h1>Title</h1><p data-note='a hidden gem'>{LONG}</p><p hidden>Not, shown.</p><p style='color:red; display : none'>Nor, this.</p></article></body>", f"Title\n{LONG}"),
    (f"<body><form id=aspnetForm><label>Find</label><div id=main><h1>Title</h1><p>{LONG}</p></div><form><p>Your name, please.</p></form></form></body>", f"Title\n{LONG}"),
    (f"<body><div class=top><a>Home</a> <a>News</a></div><div class=c1><h2>Title</h2><p>{LONG}</p></div><div class=c2>Copyright 2020, all rights.</div></body>", f"Title\n{LONG}"),
    (f"<body><div class=c1><p>{LONG}</p><p class=x>Well.</p><p>{LONG}</p></div></body>", f"{LONG}\nWell.\n{LONG}"),
    (f"<article><h1>Title</h1>{'<p>' + LONG + '</p>' * 1}{''.join('<p>' + LONG + '</p>' for _ in range(300))}</article>", "\n".join(["Title"] + [LONG] * 301)),
    (f"<body><article><p>{LONG}</p><div id=comments><p>First, ha.</p></div><div class=related-posts><p>More, here.</p></div></article></body>", LONG),
]


@pytest.mark.parametrize(("page", "text"), WHOLE_ARTICLES)
def test_article_keeps_headline_lead_and_slugs(page, text):
    assert html_extraction.main_text(page) == text


def planted_pages(n=300):
    """Pages without any semantic tag or telling class, of known blocks in a known order: (page, the article's blocks)."""
    import random

    rng = random.Random(11)
    say = lambda k: " ".join(f"{prose(rng.randrange(9999), 6)}," for _ in range(k)).capitalize().rstrip(",") + "."
    for i in range(n):
        links = "".join(f"<li><a href=/{j}>{prose(rng.randrange(999), 2)}</a></li>" for j in range(rng.randint(4, 9)))
        body = [prose(rng.randrange(9999), 5)] + [say(rng.randint(3, 7)) for _ in range(rng.randint(3, 6))] + [say(1)]
        story = f"<h2>{body[0]}</h2>" + "".join(f"<p>{x}</p>" for x in body[1:])
        parts = [
            f"<div class=a{i}><ul>{links}</ul></div>",
            f"<div class=b{i}>{story}</div>",
            f"<div class=c{i}><ul>{links}</ul></div>",
            f"<div class=d{i}>{prose(rng.randrange(999), 3)}</div>",
        ]
        rest = parts[:1] + parts[2:]
        rng.shuffle(rest)
        at = rng.randint(0, 3)
        yield f"<html><body>{''.join([*rest[:at], parts[1], *rest[at:]])}</body></html>", body


def test_ratios_alone_find_planted_articles():
    for page, body in planted_pages():
        assert html_extraction.main_text(page) == "\n".join(body)


def test_paths_decide(monkeypatch):
    """With every path counted as content, boilerplate comes along: nothing else keeps it out."""
    pages = [p for p, _ in planted_pages(20)]
    advert = f"<html><body><nav>Menu</nav><div class=ad>Buy this, now.</div><article><h1>T</h1><p>{LONG}</p></article></body></html>"
    before = [html_extraction.main_text(p) for p in [*pages, advert]]
    assert before[-1] == f"T\n{LONG}"
    monkeypatch.setattr(html_extraction, "content_paths", lambda found, fused, share: set(fused))
    assert all(a != b for a, b in zip(before, [html_extraction.main_text(p) for p in [*pages, advert]], strict=True))


def test_repeated_pages(spark):
    rows = [(1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (None, None, PAGES[0][0])]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(str(r.page_id) for r in out) == ["1", "1", "None"] and {r.text for r in out} == {PAGES[0][1]}


def test_no_page(spark):
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_very_deep_page():
    assert html_extraction.main_text("<div>" * 3000 + "<article><p>deep, text.</p></article>") == "deep, text."
