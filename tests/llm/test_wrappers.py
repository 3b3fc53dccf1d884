import html
import random
import re
import time

from pyspark.sql import functions as F

from stallwise.llm import wrappers as w


def texts(spark, pages):
    rows = [(i, u, h, "x", 1) for i, (u, h) in enumerate(pages)]
    out = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, plan int").repartition(3)).collect()
    assert len(out) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in out)
    return [x["text"] for x in sorted(out, key=lambda x: x["page_id"])]


def page(i, r):
    """A page of a site with everything around its article, and the article's text."""
    blocks = [" ".join(r.choices("alpha beta gamma delta é & <".split(), k=12)) for _ in range(r.randrange(1, 5))]
    body = "".join(f"<p>{html.escape(b)}</p>\n" for b in blocks)
    items = [" ".join(r.choices("one two three".split(), k=3)) for _ in range(r.randrange(0, 3))]
    if items:
        body += "<ul>" + "".join(f"<li> {x} " for x in items) + "</ul>"
    optional = "<aside>Related reading</aside>" if i % 3 else ""
    comments = "<section class='comments'><p>First!</p><p>Nice post</p></section>" if i % 2 else ""
    title = f"Story number {i}"
    doc = f"""<!DOCTYPE html><html><head><title>{title} - site</title><style>p {{}}</style></head><body>
    <header class="site"><p>The Site</p></header><nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div class="ad-slot">Buy now</div>
    <!-- a <p>comment</p> --><article><h1>{title}</h1>{body}<script>var a = "<p>no</p>";</script>{optional}
    <form><label>Search</label><input></form></article>{comments}<div id="sidebar">Popular</div>
    <footer>&copy; site</footer></body></html>"""
    return doc, "\n".join([title, *blocks, *items])


def test_articles_without_what_surrounds_them(spark):
    r = random.Random(3)
    made = [page(i, r) for i in range(30)]
    got = texts(spark, [(f"http://www.site.example/{i}", d) for i, (d, _) in enumerate(made)])
    assert got == [t for _, t in made]


def test_hosts_without_an_article_block(spark):
    story = ["It was a long day in town.", "Nobody came at noon.", "At last it rained.", "Then the sun came out."]
    pages = [f"<body><div><p>Site name</p><p><a href=/>Start</a></p></div><div><h2>Day {i}</h2><p>{s}</p></div><div>Imprint</div></body>" for i, s in enumerate(story)]
    got = texts(spark, [(f"https://Plain.example:80/{i}", p) for i, p in enumerate(pages)])
    assert got == [f"Day {i}\n{s}" for i, s in enumerate(story)]


def test_copies_count_as_one_page(spark):
    copy = "<body><div><p>Only story</p></div><div>Its end, {}</div></body>"
    story = [f"<body><div><p>Site</p></div><ul><li>Day {i}</ul><h3>Imprint</h3></body>" for i in range(3)]
    layout = "<body><div><p>Site</p></div><section><p>A copied layout</p></section><h3>Imprint</h3></body>"
    pages = [("http://copies/", copy.format("once")), ("http://mixed/", layout), ("http://hidden/", copy.format("twice"))] * 8
    pages = [(u, h.replace("<body>", f"<body><!-- {i} --><script>{i}</script>") if "hidden" in u else h) for i, (u, h) in enumerate(pages)]
    pages += [("http://mixed/", s) for s in story]
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    want = {"http://copies/": "Only story\nIts end, once", "http://mixed/": "A copied layout", "http://hidden/": "Only story\nIts end, twice"}
    for parts in (1, 2, 9):
        got = [x["text"] for x in w.main_text(rows.repartition(parts)).orderBy("page_id").collect()]
        assert got == [want[u] for u, _ in pages[:24]] + ["Day 0", "Day 1", "Day 2"], parts


def test_marked_blocks_around_an_article(spark):
    story = "<article><p>Story {}</p><div class='share'>Share it</div></article>"
    side = "<div class='related'><article>Teaser</article></div>"
    pages = [
        (f"<div class='content-sidebar-wrap'><h4>Search</h4>{story}</div>", "Story {}"), (f"<main><h1>Day</h1><div class='ad notice'>{story}</div></main>", "Day\nStory {}"),
        (f"<div>{story}</div>{side}", "Story {}"), (f"<nav class='search'>{story}</nav><p>Other {{}}</p>", "Other {}"), (f"<div class='comments'>{story}</div><p>Other {{}}</p>", "Other {}"),
    ]
    rows = [(f"http://h{k}/", f"<body>{h.replace('{}', str(i))}</body>", t.format(i)) for k, (h, t) in enumerate(pages) for i in range(4)]
    assert texts(spark, [(u, h) for u, h, _ in rows]) == [t for *_, t in rows]


def test_driver_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {x["page_id"]: x for x in w.main_text(rows).collect()}
    for x in rows.collect():
        article = re.search(r"<article>(.*?)</article>", x["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert out[x["page_id"]]["text"] == "\n".join(b for b in blocks if b), x["url"]
        assert out[x["page_id"]]["url"] == x["url"]


def test_defined_cases(spark):
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    pages = [(None, None), ("", ""), ("nonsense", "plain  text\nonly"), ("http://a/", "<p>a<p>b<br>c &lt;x&gt; 1 < 2"), ("http://a/", deep), ("//b", long), ("http://c", "<p>cut <b")]
    got = texts(spark, pages)
    assert got[0] == got[1] == "" and got[2] == "plain text only"
    assert got[3] == "a\nb\nc <x> 1 < 2" and got[4] == "deep" and got[5] == "\n".join(["word & word"] * 20_000) and got[6] == "cut"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.main_text(empty).collect() == []


def test_wrappers_fold_and_generalise():
    a = w.infer(map(w.parse, ["<body><h1>A</h1><p>x</p><p>y</p><p>z</p></body>", "<body><h1>A</h1><div>d</div><p>q</p></body>"]))
    (body,) = a[w.CHILDREN]
    assert [(x[w.KEY], x[w.LEAST], x[w.MOST]) for x in body[w.CHILDREN]] == [("h1", 1, 1), ("div", 0, 1), ("p", 1, 2)]
    (h1,), (p,) = body[w.CHILDREN][0][w.CHILDREN], body[w.CHILDREN][2][w.CHILDREN]
    assert h1[w.CONSTANT] == "A" and p[w.CONSTANT] is None and len(a[w.SEEN]) == 2
    pairs = w.infer(map(w.parse, ["<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"]))
    assert [x[w.KEY] for x in pairs[w.CHILDREN][0][w.CHILDREN]] == ["dt", "dd"]


def extracted(pages):
    """The texts of one host's pages by their wrapper, without Spark."""
    plan = w.mark(w.infer(map(w.parse, pages)))
    return [w.extract(w.parse(p), plan) for p in pages]


def test_constants_and_slots_decide_in_articles_too():
    r = random.Random(1)
    story = [" ".join(r.choices("alpha beta gamma delta epsilon".split(), k=20)) for _ in range(10)]
    pages = [f"<article><h1>Day {i}</h1><div>Support us with a gift.</div><p>{s}</p><p>{s[::-1]}</p><div>All our stories</div></article>" for i, s in enumerate(story)]
    assert extracted(pages) == [f"Day {i}\n{s}\n{s[::-1]}" for i, s in enumerate(story)]
    # The same page alone, or with too few others, has no evidence against those lines.
    assert extracted(pages[:1])[0] == f"Day 0\nSupport us with a gift.\n{story[0]}\n{story[0][::-1]}\nAll our stories"
    # Ten pages that are all but copies: what is constant is the story.
    near = [f"<body><div><h2>One story</h2></div><div>{story[0]}</div><section>{story[1]}</section><i>{i}</i></body>" for i in range(10)]
    assert extracted(near) == [f"One story\n{story[0]}\n{story[1]}\n{i}" for i in range(10)]


def test_marks_are_hints_where_they_are_doubtful():
    body = "<p id='search-results-in-physics'>One {0}</p><p class='tags'>Two {0}</p><p class='alert-free text'>Three {0}</p>"
    links = "<p class='tags'><a href=/{0}>tag {0}</a></p>"
    side = "<div class='ad-slot'>Buy {0}</div><div id='related-posts'>See {0}</div><p class='advert'>Buy {0}</p><ul class='social-share-buttons'><li>Share {0}</ul>"
    pages = [f"<article><h1>T{i}</h1><div>{body.format(i)}</div><section>{links.format(i)}</section>{side.format(i)}</article>" for i in range(4)]
    assert extracted(pages) == [f"T{i}\nOne {i}\nTwo {i}\nThree {i}" for i in range(4)]


def test_no_order_copy_or_partition_matters(spark):
    r = random.Random(8)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta".split())
    pages = []
    for i in range(60):
        parts = [f"<{t}>{' '.join(word() for _ in range(6))}</{t}>" for t in r.choices(("p", "h2", "div", "blockquote", "section"), k=r.randrange(1, 7))]
        constant = "<div>Imprint</div>" * (i % 2) + "<section><p>Stay</p><p>tuned</p></section>" * (i % 3 == 0)
        pages.append((i, "http://h/", f"<body>{constant}<div>{''.join(parts)}</div>{constant}</body>"))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {x["page_id"]: x["text"] for x in w.main_text(rows.coalesce(1)).collect()}
    assert any(want.values())
    shuffled = spark.createDataFrame(r.sample(pages, 60) + pages[::3] + pages[:9] * 4, rows.schema)
    for parts in (1, 7):
        assert all(want[x["page_id"]] == x["text"] for x in w.main_text(shuffled.repartition(parts)).collect()), parts


def test_plans_joined_where_they_are_too_many_to_send(spark, monkeypatch):
    pages = [(f"http://h{i % 3}/", f"<body><article><p>Text {i}</p></article><div>Site</div></body>") for i in range(12)]
    want = texts(spark, pages)
    monkeypatch.setattr(w, "SMALL_HOSTS", 1)
    assert texts(spark, pages) == want == [f"Text {i}" for i in range(12)]


def test_deep_and_wide_pages():
    n = 10_000
    assert extracted(["<div>" * n + "deep" + "</div>" * n]) == ["deep"]
    mixed = "".join(f"<div>{i}" for i in range(500)) + "".join(f"{i}</div>" for i in range(500))
    assert extracted([mixed])[0].split("\n") == [*map(str, range(499)), "4990", *map(str, range(1, 500))]
    hidden = "<div>" * 150 + "<nav><div><p>menu</p></div></nav><p>text</p>" + "</div>" * 150
    assert extracted([hidden]) == ["text"]
    tags = ("p", "div", "blockquote", "h2", "pre")
    r = random.Random(2)
    wide = ["".join(f"<{t}>{t} {k} {i}</{t}>" for k, t in enumerate(r.choices(tags, k=4000))) for i in range(3)]
    assert extracted([f"<body>{x}</body>" for x in wide]) == ["\n".join(re.findall(r">([^<]+)<", x)) for x in wide]


def test_hosts(spark):
    urls = ["http://A.example/x", "https://u:p@b:8/", "//c?x", "d/e", None, " http://e#x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [x[0] for x in df.select(w.host_of(F.col("u"))).collect()] == ["a.example", "b", "c", "", "", "e"]


def recipe(i, around):
    """A page whose headings and closing line are on every page of its host."""
    story = f"<h1>Cake {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs<li>Salt</ul><h2>Method</h2><p>Mix for {i} minutes.</p><p>Serve warm.</p>"
    want = f"Cake {i}\nIngredients\n{i} eggs\nSalt\nMethod\nMix for {i} minutes.\nServe warm."
    return f"<body><nav><a href=/>Home</a></nav><div><p>Our kitchen</p></div>{around.format(story)}<div>Imprint</div><footer>All rights</footer></body>", want


def test_constant_lines_of_a_story_stay_whatever_the_host(spark):
    for around in ("<article>{}</article>", "<main><div>{}</div></main>", "<div>{}</div>", "<div><section>{}</section></div>"):
        for n in (3, 7, 8, 100):
            made = [recipe(i, around) for i in range(n)]
            assert extracted([p for p, _ in made]) == [t for _, t in made], (around, n)
    page, want = recipe(1, "<article>{}</article>")
    assert extracted([page]) == [want]
    conclusion = [f"<body><div>Site</div><div><h1>On {i}</h1><p>Words of {i}</p><h2>Conclusion</h2><p>So {i}.</p></div></body>" for i in range(5)]
    assert extracted(conclusion) == [f"On {i}\nWords of {i}\nConclusion\nSo {i}." for i in range(5)]


def test_words_that_begin_like_marks_are_none():
    story = "<article><h1>T{0}</h1><section class='commentary'>Said {0}</section><div class='sponsorship'>Paid {0}</div><div class='popup-text'>Up {0}</div><div class='comments'>No {0}</div><div class='sponsored'>No {0}</div><div class='ad-text'>No {0}</div></article>"
    for n in (1, 9):
        assert extracted([story.format(i) for i in range(n)]) == [f"T{i}\nSaid {i}\nPaid {i}\nUp {i}" for i in range(n)]


def test_the_wrapper_alone_finds_the_text(spark):
    """Pages of a host whose tags and names say nothing: 0.95 of the text, and what is the same on all of them goes."""
    for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect():
        article = re.search(r"<article>(.*?)</article>", x["html"], re.S)[1]
        bodies = [re.sub(r"\w+", lambda m: m[0][::-1] if k else m[0], re.sub(r"<[^>]*>", "\n", article)) for k in range(2)]
        pages = ["<div><p>Site</p></div><div>" + "".join(f"<p>{line} {k}</p>" for line in body.split("\n") if line.strip()) + "</div><div>Imprint</div>" for k, body in enumerate([*bodies, "one\ntwo", "three\nfour"])]
        got = extracted(pages)
        want = [" ".join(html.unescape(f"{line} {k}").split()) for k, body in enumerate(bodies[:1]) for line in body.split("\n") if line.strip()]
        assert sum(map(len, got[0].split("\n"))) >= 0.95 * sum(map(len, want)) and "Site" not in got[0].split("\n") and "Imprint" not in got[0].split("\n")


def test_time_goes_with_the_length():
    n = 40_000
    began = time.process_time()
    for page in ("<div>" * n + "</section>" * n, "<p>" * n + "</p>" * n, "<svg>" * n, "<head>" * n, "<div>" * n + "<li>" * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<td>" * n + "</tr>" * n, "</p>" * 4 * n):
        w.parse(page + "<p>end")
    assert time.process_time() - began < 40
