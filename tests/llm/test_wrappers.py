from casebook.llm import wrappers


def test_blocks():
    page = """<!doctype html><html><head><title>t</title></head><body><header>top</header><nav>menu</nav><!-- <p>no</p> -->
    <article class="post"><h1>A &amp; B</h1><p><b>One<br>two <i>three</i><p>four &lt;x&gt; <a href="a>b">five</a><ul><li>six<li>seven</ul>
    <div class="share-box">share</div><script>var a = "</p>";</script><aside>side</aside>a < b</article><div id="comments"><p>first!</p></div><footer>end</footer>"""
    assert wrappers.text_of(page, None, frozenset(), None) == "A & B\nOne two three\nfour <x> five\nsix\nseven\na < b"
    for broken in ("", "<", "<p", "</div></div>x", "<script>never closed", "<a 'b>c</a> d", "<p>" * 300):
        wrappers.text_of(broken, None, frozenset(), None)


def test_simple_tree_matching():
    tree = wrappers.reference("<div><p>a</p><p>b</p><hr></div><ul><li>x</li></ul>")
    groups = wrappers.grouped([x for x in wrappers.parse("<div><p>c</p></div><table></table><ul><li>y</li><li>z</li></ul>").parts if isinstance(x, wrappers.Node)])
    score, pairs = wrappers.match(tree, groups)
    assert score == 4 and {n: g.label for n, g in pairs} == {0: "div", 1: "p", 2: "ul", 3: "li"}


def test_template_of_a_host(llm, texts):
    rows, want = [], {}
    for i in range(24):
        body = [texts.prose(12) for _ in range(texts.r.randint(1, 5))]
        html = f"<body><div><p>Welcome to our site</p></div><div class='x'><h2>{body[0]}</h2>{''.join(f'<p>{b}</p>' for b in body[1:])}<section>All rights kept here</section></div></body>"
        rows.append((i, f"https://A.example/{i}", html))
        want[i] = "\n".join(body)
    rows += [(100, None, None), (101, "nonsense", ""), (102, "https://b.example", "<p>lonely"), (103, "https://a.example", "<p>" + "long " * 30_000)]
    df = llm.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in wrappers.extract(df).collect()]
    assert len(got) == len(rows) + 1
    for i, text, n in got:
        assert n == len(text)
        if i < 100:
            assert text == want[i]
    assert {i: t[:9] for i, t, _ in got if i >= 100} == {100: "", 101: "", 102: "lonely", 103: "long long"}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_names_are_evidence_only(llm, texts):
    """Slots choose the text on all pages; ids, parts of class names and layout classes leave nothing out."""
    parts = '<h2 id="social-impact">{}</h2><section id="related-work"><p>{}</p></section><p class="notice">{} <span class="notice">{}</span></p><div class="share">{}</div>'
    pages, want = [], {}
    for i in range(12):
        b = [texts.prose(15) for _ in range(6)]
        # the body in a div, teaser cards as articles
        cards = "".join(f"<article class='card'><p>{texts.prose(3)}</p></article>" for _ in range(3))
        pages.append((i, f"https://cards.example/{i}", f"<body><div class='content'><h1>{b[0]}</h1><p>{b[1]}</p><p>{b[2]}</p></div>{cards}</body>"))
        want[i] = "\n".join(b[:3])
        pages.append((100 + i, f"https://names.example/{i}", f"<body><article class='post category-social'>{parts.format(*b)}<p>{b[5]}</p></article><div class='comments'><p>hi</p></div></body>"))
        want[100 + i] = "\n".join([b[0], b[1], f"{b[2]} {b[3]}", b[4], b[5]])
    b = [texts.prose(15) for _ in range(5)]
    pages.append((200, "https://single.example/1", f"<body class='right-sidebar'><article class='post category-social'>{parts.format(*b)}</article></body>"))
    want[200] = "\n".join([b[0], b[1], f"{b[2]} {b[3]}"])
    got = {r.page_id: r.text for r in wrappers.extract(llm.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_copies_and_templates(llm, texts):
    """Copies of a page count once, and each template of a host has its wrapper."""
    pages, want = [], {}
    copy = [texts.prose(20) for _ in range(3)]
    for i in range(40):  # a page in many copies, that differ in an advert
        ad = f"<div class='ad'>{texts.prose(4)}</div><script>track({i})</script>"
        pages.append((i, f"https://copies.example/{i}", f"<body>{ad}<article><h1>{copy[0]}</h1><p>{copy[1]}</p><p>{copy[2]}</p></article></body>"))
        want[i] = "\n".join(copy)
    for i in range(40, 52):  # two templates
        b = [texts.prose(15) for _ in range(3)]
        pages.append((i, f"https://two.example/{i}", f"<body><div class='post'><h1>{b[0]}</h1><p>{b[1]}</p></div><div class='legal'><p>{texts.prose(3)}</p></div><p>All kept</p></body>"))
        want[i] = "\n".join(b[:2])
        pages.append((i + 100, f"https://two.example/{i}", f"<body><div class='top'><p>Our second site</p></div><div class='story'><h2>{b[0]}</h2><p>{b[2]}</p></div></body>"))
        want[i + 100] = f"{b[0]}\n{b[2]}"
    got = {r.page_id: r.text for r in wrappers.extract(llm.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == want


def naive(a, b):
    """Most matched nodes of two sequences of (label, children), by the definition."""
    if not a or not b:
        return 0
    (x, inner), (y, other) = a[-1], b[-1]
    best = max(naive(a[:-1], b), naive(a, b[:-1]))
    return max(best, naive(a[:-1], b[:-1]) + 1 + naive(inner, other)) if x == y else best


def test_matching_against_the_definition(texts):
    def html(n):
        tags = [texts.r.choice(["p", "h2", "div", "section"]) for _ in range(n)]
        return "".join(f"<{t}>{html(2) if t in ('div', 'section') and texts.r.random() < 0.4 else 'x'}</{t}>" for t in tags)

    def plain(groups):
        return [(g.label, plain(g.children)) for g in groups]

    def groups(page):
        return wrappers.grouped([x for x in wrappers.parse(page).parts if isinstance(x, wrappers.Node)])

    for _ in range(60):
        p, q = html(texts.r.randint(0, 6)), html(texts.r.randint(0, 6))
        score, pairs = wrappers.match(wrappers.reference(p), groups(q))
        assert score == naive(plain(groups(p)), plain(groups(q))) == len(pairs) == len({n for n, _ in pairs})


def test_wide_sequences_match_as_narrow_ones(texts, monkeypatch):
    parts = ["<p>a</p>", "<h2>b</h2>", "<div><p>a</p></div>", "<div><h2>a</h2><p>b</p></div>", "<ul><li>x</ul>"]
    for _ in range(10):
        p, q = ("".join(texts.r.choices(parts, k=texts.r.randint(60, 120))) for _ in range(2))
        groups = wrappers.grouped([x for x in wrappers.parse(q).parts if isinstance(x, wrappers.Node)])
        found = []
        for wide in (0, 10**9):
            monkeypatch.setattr(wrappers, "WIDE", wide)
            score, pairs = wrappers.match(wrappers.reference(p), groups)
            found.append((score, [(n, id(g)) for n, g in pairs]))
        assert found[0] == found[1]


def test_pages_that_are_deep_or_broken():
    """No page is too deep, and what is left open costs no more than its length."""
    deep = "<div>" * 100_000 + "inside"
    tree = wrappers.reference(deep)
    assert wrappers.text_of(deep, tree, frozenset(), None) == "inside" and len(wrappers.flat_reference(deep)) == 100_000
    assert len(wrappers.match(tree, wrappers.grouped([x for x in wrappers.parse(deep).parts if isinstance(x, wrappers.Node)]))[1]) == 100_000
    for broken, text in (
        ("<a " * 300_000, ("<a " * 300_000).strip()), ("<a \"" * 200_000 + ">", None), ("<!" * 300_000, "<!" * 300_000), ("<p>x<button>" * 50_000, None),
        ("<script>" + "</script" * 100_000, ""), ("<p>y" + "<div>" * 20_000 + "</ul>" * 50_000, "y"), ("<div class=ad>" * 20_000 + "y<article>z", "z"),
    ):
        got = wrappers.text_of(broken, None, frozenset(), None)
        assert text is None or got == text
    siblings = "<p>x</p><h2>y</h2>" * 10_000
    assert wrappers.text_of(siblings + "<p>end", wrappers.reference(siblings), frozenset(), 0) == "x\ny\n" * 10_000 + "end"
