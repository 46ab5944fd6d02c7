from factloom.llm import html_extract as H

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><header class="site-header">Site</header>'
    '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1>'
    "<p><b>First&nbsp;paragraph.<br><p>Second\n  paragraph &lt;x&gt;.</p><ul><li>one<li>two</ul><aside>side</aside><form>mail</form><p>1 < 2</p></article>"
    '<section id="comments"><article class="comment">spam</article></section><div class="sidebar">links</div><footer>&copy; site</footer></body></html>'
)


def test_main_text():
    assert H.main_text(PAGE) == "Title & more\n\nFirst paragraph.\n\nSecond paragraph <x>.\n\none\n\ntwo\n\n1 < 2"


def test_malformed():
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("<p>a<!-- open <p>b") == "a"
    assert H.main_text("</p></div>x</b>") == "x"
    assert H.main_text('<p title="a>b">c') == "c"
    assert H.main_text("<div hidden>a</div><p style='display: none'>b</p>c") == "c"
    assert H.main_text("<main>m</main><p>outside") == "m"
    assert H.main_text("<div>" * 20000 + "deep") == "deep"
    assert H.main_text("<" * 20000) == "<" * 20000
    assert H.main_text("<body class='has-sidebar'><p>kept</p></body>") == "kept"
    assert H.main_text("<div class='side-bar'>a</div><div id='readerComments'>b</div><p class='user_comments'>c</p>d") == "d"


def test_slugs_and_wrappers_keep_articles():
    parts = '<h2 id="related-work">Related work</h2><section id="discussion"><h2 id="social-effects">Effects</h2><p>Text</p></section><div class="promotion-history" id="recommendations"><p>More</p></div><h3 id="header-files">Files</h3><div id="page-header"><p>Lead</p></div>'
    said = "Related work\n\nEffects\n\nText\n\nMore\n\nFiles\n\nLead"
    assert H.main_text(f'<article>{parts}<div class="box promo">Buy</div></article>') == said
    assert H.main_text(f"<main>{parts}</main>") == said
    for wrapper in ('div class="layout sidebar-right"', 'div class="page menu-open"', 'div class="menu"', 'div id="sidebar"', "form"):
        tag = wrapper.split()[0]
        assert H.main_text(f"<nav>n</nav><{wrapper}><article>{parts}</article></{tag}>") == said
        assert H.main_text(f"<nav>n</nav><{wrapper}><main>{parts}</main></{tag}>") == said
    assert H.main_text('<article id="post-1" class="post comment-open">a</article><aside><article>b</article></aside><div class="related"><article>c</article></div>') == "a"
    assert H.main_text('<p>a</p><h2 id="related-work">b</h2>') == "a\n\nb"
    assert H.main_text("<template><article>no</article></template><div hidden><article>no</article></div><p>a") == "a"


def test_articles_of_small_sites_stay(spark):
    rows = [(i, f"http://small.example/{i}", f"<article><p>The same text on every page</p><p>Part {i}</p></article>") for i in range(6)]
    rows += [(100 + i, f"http://large.example/{i}", f"<article><div>Share this story</div><p>Story {i}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "The same text on every page\n\nPart 3" and got[103] == "Story 3"


def test_boxes_in_articles_of_large_sites(spark):
    promo = "<div><p>Sign up for</p><p>our letter</p></div>"
    words = "with some more words that no other page has"
    rows = [(i, f"http://large.example/{i}", f"<article>{'<h1>The same title</h1>' if i % 3 == 0 else ''}{promo if i < 12 else ''}<p>Story {i} {words}</p></article>") for i in range(120)]
    # an article copied as it is, and one copied with another date each time
    rows += [(200 + i, f"http://large.example/{i}/copy", f"<nav>{i}</nav><article><div><p>One article</p></div><p>as it is, copied whole and much longer</p></article>") for i in range(15)]
    rows += [(300 + i, f"http://large.example/{i}/dated", f"<article><p>{i}</p><div><p>The same news</p></div><div><p>on every date</p></div></article>") for i in range(15)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    assert H.site_boxes(df, task_entries=5).count() == 3
    for limit in (300_000, 0):
        got = {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()}
        assert got[3] == f"The same title\n\nStory 3 {words}" and got[51] == f"The same title\n\nStory 51 {words}"
        assert got[203].startswith("One article") and got[303] == "3\n\nThe same news\n\non every date"


def pages(n):
    share = '<div class="box"><p>Follow us on every network there is</p></div>'
    return [(i, f"http://h.example/{i}", f"<body>{share}<p>Story number {i} is here</p><p>Another line {i * 7}</p></body>") for i in range(n)] + [(100, "http://other.example/", f"<body>{share}<p>alone</p></body>"), (101, None, None), (102, "::bad[", "<p>x"), (102, "::bad[", "<p>x")]


def test_templates(spark):
    df = spark.createDataFrame(pages(12), "page_id bigint, url string, html string").repartition(3)
    for rows in (300_000, 0):  # broadcast, and joined by host
        got = {r.page_id: r for r in H.extract(df, broadcast_rows=rows).collect()}
        assert got[3].text == "Story number 3 is here\n\nAnother line 21" and got[3].n_chars == len(got[3].text)
        assert got[100].text == "Follow us on every network there is\n\nalone"
        assert got[101].text == "" and got[102].text == "x"
    assert H.extract(df).count() == 16
    assert H.extract(df.limit(0)).count() == 0


def test_counts_match_brute_force(spark):
    rows = pages(9)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    counts, hosts = {}, {}
    for _, url, html in rows:
        host = H.host_of(url)
        hosts[host] = hosts.get(host, 0) + 1
        for h in {n.hash for n in H.walk(H.parse(html or "")) if n.words and n.tag not in ("", "html", "body", "article", "main")}:
            counts[host, h] = counts.get((host, h), 0) + 1
    want = {(h, s): n / hosts[h] if n >= 10 else min(n / hosts[h], 0.495) for (h, s), n in counts.items() if n >= 4 and n / hosts[h] >= 0.1}
    got = {(r.host, r.subtree % (1 << 64)): r.share for r in H.site_templates(df, task_entries=5).collect()}
    assert got == want and want


def test_comments_and_wrappers():
    assert H.main_text("<p>one</p><!--><p>two</p>") == H.main_text("<p>one</p><!---><p>two</p>") == "one\n\ntwo"
    assert H.main_text("a<!-- x --!>b") == "ab"
    parts = '<p class="share-price">Up</p><p class="light-rail">Tram</p><p id="reply">Reply</p>'
    assert H.main_text(f"<article>{parts}</article>") == H.main_text(f"<main>{parts}</main>") == "Up\n\nTram\n\nReply"
    assert H.main_text("<nav>n</nav><main><h1>Title</h1><p>Lead</p><article><p>Body</p></article><p>End</p></main><div>x</div>") == "Title\n\nLead\n\nBody\n\nEnd"
    assert H.main_text("<main><article>a</article><article>b</article></main>c") == "a\n\nb"


def test_unmatched_tags_take_linear_time():
    import time

    began = time.perf_counter()
    assert H.main_text("<b>" * 16000 + "</x>" * 16000 + "text") == "text"
    assert H.main_text("<p><button>" + "<b>" * 16000 + "<div></div>" * 16000 + "<ul>" + "<li></li>" * 16000) == ""
    assert time.perf_counter() - began < 4


def site(n, host="h.example", other=False):
    """Pages whose menu, advert and footer have other words on each page."""
    def page(i):
        frame = f'<ul class="menu">{"".join(f"<li><a href=/{k}>link {i * k}</a></li>" for k in range(3 + i % 3))}</ul><div class="box">Buy number {i}</div>'
        text = f"<h1>Title {i}</h1><p>Story {i} is here.</p>" + "".join(f"<p>Part {i}.{k}, with many more words than all the rest of the page has.</p>" for k in range(1 + i % 2))
        text = f'<div class="text">{text}</div>' if other else f"<article>{text}</article>"
        return f"<body><div id='p{i}'>{frame}{text}<div class='end'>Page {i} of <b>{host}</b></div></div></body>"

    said = lambda i: f"Title {i}\n\nStory {i} is here." + "".join(f"\n\nPart {i}.{k}, with many more words than all the rest of the page has." for k in range(1 + i % 2))
    return [(i, f"http://{host}/{i}", page(i), said(i)) for i in range(n)]


def test_shapes_recur_while_words_change(spark):
    """Without class words: 'box', 'end' and 'text' are in no list."""
    rows = site(12) + [(100 + i, u, h, t) for i, u, h, t in site(12, "o.example", other=True)]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(3)
    for limit in (300_000, 0):
        got = {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()}
        assert all(got[i] == text for i, _, _, text in rows if i < 100)
        assert all("Buy" not in got[i] and "Page" not in got[i] and got[i].startswith("Title") for i, _, _, _ in rows if i >= 100)
    off = H.Site(counted=True)
    assert all(H.main_text(html, off) != text for _, _, html, text in rows)
    # the marked text alone says nothing on a host that marks it on few pages
    shapes = {r.subtree % (1 << 64) for r in H.site_shapes(df.where("page_id < 100")).collect()}
    assert all(H.main_text(html, H.Site(counted=True, shapes=shapes)) == text for i, _, html, text in rows if i < 100)


def test_templates_decide_on_the_tables(spark):
    """With the templates of the hosts left out nearly every page has another text."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    rows = pq.read_table(path).to_pylist()
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet(path)).collect()}
    hosts = {}
    for r in rows:
        hosts[H.host_of(r["url"])] = hosts.get(H.host_of(r["url"]), 0) + 1
    counted = [r for r in rows if hosts[H.host_of(r["url"])] >= 4]
    changed = sum(H.main_text(r["html"], H.Site(counted=True)) != got[r["page_id"]] for r in counted)
    assert len(counted) > 100 and changed == len(counted)
    # all shapes but no mark: the subtrees that recur by shape are all that goes
    shapes = {}
    for r in H.site_shapes(spark.read.parquet(path)).collect():
        shapes.setdefault(r.host, set()).add(r.subtree % (1 << 64))
    same = sum(H.main_text(r["html"], H.Site(counted=True, shapes=shapes.get(H.host_of(r["url"]), set()))) == got[r["page_id"]] for r in counted)
    assert same > 0.98 * len(counted)


LINE = "The study was funded by the council."


def funded(n, tag, where, host="h.example"):
    """Pages with a text of their own, some of which end with the same line."""
    rows = []
    for i in range(n):
        own = "".join(f"<p>Text {i}.{k} of this page alone, and some words more.</p>" for k in range(3))
        last = f"<p>{LINE}</p>" if i < where else ""
        rows.append((i, f"http://{host}/{i}", f'<body><ul class="top"><li><a href="/">Home</a></li></ul><{tag}>{own}{last}</{tag}><div class="low">Page {i} of {host}</div></body>'))
    return rows


def test_lines_of_main_parts_stay(spark):
    """A line on a tenth of a host's pages stays in articles, main elements and bare containers alike, with 3 pages and with 4."""
    for n, where in ((40, 4), (3, 3), (4, 4), (4, 1), (12, 5)):
        for tag in ("article", "main", "div", "section"):
            rows = funded(n, tag, where)
            got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} if (n, where) in ((40, 4), (4, 4)) else {i: H.main_text(h, alone(rows)) for i, _, h in rows}
            for i in range(n):
                assert (LINE in got[i]) == (i < where) and f"Text {i}.2 of this page alone" in got[i], (n, where, tag)
            if n > 3 or tag in ("article", "main"):
                assert all("Page" not in t and "Home" not in t for t in got.values()), (n, where, tag)


def alone(rows, min_pages=4):
    """What a host's pages have in common, counted without Spark."""
    import pyarrow as pa

    sums = {}
    for batch in H._count(10**9)(iter([pa.RecordBatch.from_pydict({"u": [r[1] for r in rows], "h": [r[2] for r in rows]})])):
        for x in batch.to_pylist():
            sums[x["kind"], x["subtree"], x["content"]] = x["pages"]
    n = len(rows)
    site = H.Site(counted=n >= min_pages)
    if not site.counted:
        return site
    site.marked = sums.get((H.MARKED, None, None), 0) / n >= 0.5
    boxes = {}
    for (kind, subtree, _), pages in sums.items():
        if kind == H.SUBTREE and pages >= min_pages and pages / n >= 0.1:
            site.shares[subtree % (1 << 64)] = pages / n if pages >= 10 else min(pages / n, 0.495)
        elif kind == H.SHAPE and pages >= min_pages and pages / n >= 0.1:
            site.shapes.add(subtree % (1 << 64))
        elif kind == H.BOX:
            boxes[subtree] = boxes.get(subtree, 0) + 1
    site.boxes = {b % (1 << 64) for b, k in boxes.items() if k >= 10}
    return site


def test_query_against_counts_without_spark(spark, tmp_path):
    """The whole query over hosts of all sizes equals texts from counts made without Spark; and the counts alone change pages."""
    from factloom.llm import queries as Q

    rows = []
    for k, (n, where, tag) in enumerate(((40, 4, "main"), (12, 6, "div"), (3, 3, "article"), (9, 9, "section"), (1, 1, "div"), (25, 25, "div"))):
        rows += [(100 * k + i, u, h) for i, u, h in funded(n, tag, where, f"h{k}.example")]
    rows += [(900 + i, u, h) for i, u, h, _ in site(14, "s.example")] + [(990, None, None), (991, "http://long.example/", "<p>" + "word " * 300_000)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    by = {}
    for r in rows:
        by.setdefault(H.host_of(r[1]), []).append(r)
    want = {i: H.main_text(h, alone(group)) for group in by.values() for i, _, h in group}
    got = {r.page_id: r for r in Q.QUERIES["op3_html_extraction"](spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    off = {i: H.main_text(h) for i, _, h in rows}
    assert sum(off[i] != want[i] for i in want) >= 40  # class lists without counts
