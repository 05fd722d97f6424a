"""Main text: single pages, and templates that only counting over a host's pages can find."""

import random
from collections import Counter, defaultdict

from emberline.llm.html import extract, main_text, parse, site_templates, subtree_hashes


def test_main_text():
    from emberline.llm.html import main_text, parse

    page = """<html><head><title>t</title></head><body><header>H</header><nav>n</nav><div class="cookie-notice">c</div>
    <article><h1>Head &amp; more</h1><p>one<br>two <b>three</b><p>four<div class="ad">buy</div><form>f</form><ul><li>x<li>y</ul>
    <section id="comments"><p>c1</p></section></article><aside>s</aside><footer>f</footer><script>var a="<p>";</script></body></html>"""
    assert main_text(parse(page)) == "Head & more\n\none two three\n\nfour\n\nx\n\ny"
    assert main_text(parse("")) == ""


def test_whole_names_only_and_nothing_else_dropped():
    page = """<body><article><div class="article-header"><h1>Title</h1></div><h2 id="related-work">Related work</h2><p id="notice-period">Notice</p>
    <p class="share-price">Price</p><div class="ads">Buy</div><div class="Cookie-Notice x">c</div></article><article><p>Second</p></article><div class="menu">m</div></body>"""
    assert main_text(parse(page)) == "Title\n\nRelated work\n\nNotice\n\nPrice\n\nSecond"


def test_pages_of_any_depth():
    deep = "<div>" * 3000
    assert main_text(parse(f"<body><article>{deep}<nav>n</nav><p>in</p>{'</div>' * 3000}<p>out</p></article></body>")) == "in\n\nout"
    assert main_text(parse("<body>" + "<b>" * 5000 + "x" + "</i>" * 5000)) == "x"


def host_pages(r, hosts, pages):
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for h in range(hosts):
        top, box, low = (words(8) for _ in range(3))
        for p in range(pages):
            text, key = [words(30), words(20)], len(rows)
            shape = r.randrange(2)
            body = f"<p>{text[0]}</p><div class=q{h}>{box}</div><p>{text[1]}</p>"
            body = f"<article>{body}</article>" if shape else f"<div>{body}</div>"
            rows.append((key, f"http://Host{h}.example/{p}", f"<html><body><div><span>{top}</span></div>{body}<div>{low}</div></body></html>"))
            want[key] = "\n\n".join(text)
    return rows, want


def test_recurring_subtrees_go_and_equal_brute_force(spark):
    rows, want = host_pages(random.Random(3), 3, 12)
    rows += [(100, None, None), (101, "http://single.example/", "<body><div>alone</div><p>text</p></body>"), (102, "u", ""), (101, "http://single.example/", "<body><div>alone</div><p>text</p></body>"), (None, "http://Host0.example/x", rows[0][2])]
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], "page_id long, url string, html string, host string, templates int")
    got = {x.page_id: x for x in extract(frame).collect() if x.page_id != 101}
    assert {k: got[k].text for k in want} == want and all(x.n_chars == len(x.text) for x in got.values())
    assert got[100].text == got[102].text == "" and [x.text for x in extract(frame.filter("page_id = 101")).collect()] == ["alone\n\ntext"] * 2
    by = defaultdict(dict)
    for _, url, html in rows:
        if html is not None:
            root = parse(html)
            host = (url or "").lower().split("/")[2] if "//" in (url or "") else ""
            by[host].setdefault(main_text(root), set()).update(subtree_hashes(root))
    plain = {}
    for host, contents in by.items():
        counts = Counter(s for subtrees in contents.values() for s in subtrees)
        found = {s for s, n in counts.items() if n >= 5 and n >= 0.3 * len(contents)}
        if found:
            plain[host] = found
    assert {x.host: set(x.templates) for x in site_templates(frame).collect()} == plain and len(plain) == 3
    assert extract(frame.limit(0)).count() == 0
