import random
from html.parser import HTMLParser

import pytest

from glyphmill.llm import html_extract as H

LONG = "Words, and more words, that make this a real paragraph of some length, with commas. "


def naive(html):
    """Score and text by walking a tree of dicts, for well-formed pages whose texts stand in p, a and span."""
    root = {"tag": "#root", "kids": [], "up": None}

    class Parser(HTMLParser):
        node = root

        def handle_starttag(self, tag, attrs):
            new = {"tag": tag, "kids": [], "up": self.node}
            self.node["kids"].append(new)
            self.node = new

        def handle_endtag(self, tag):
            self.node = self.node["up"]

        def handle_data(self, data):
            self.node["kids"].append(data)

    p = Parser()
    p.feed(html)
    p.close()

    def texts(n, links_only=False, inside=False):
        inside = inside or n["tag"] == "a"
        for k in n["kids"]:
            if isinstance(k, str):
                if not links_only or inside:
                    yield " ".join(k.split())
            else:
                yield from texts(k, links_only, inside)

    points, order = {}, []

    def walk(n):
        order.append(n)
        if n["tag"] == "p":
            size, commas = sum(map(len, texts(n))), sum(t.count(",") for t in texts(n))
            if size >= H.LEAST:
                up, gain = n, 1 + commas + min(3, size // 100)
                for level in range(H.LEVELS):
                    if up["up"] is None:
                        break
                    up = up["up"]
                    points[id(up)] = points.get(id(up), 0) + gain / (1, 2, 6, 9, 12)[level]
        for k in n["kids"]:
            if not isinstance(k, str):
                walk(k)

    walk(root)

    def density(n):
        size = sum(map(len, texts(n)))
        return sum(map(len, texts(n, True))) / size if size else 0

    def score(n):
        return points.get(id(n), 0) * (1 - density(n))

    def lines(n):
        out = [""]

        def go(n):
            block = n["tag"] in ("div", "p", "h2", "nav")
            out.extend([""] * block)
            for k in n["kids"]:
                if isinstance(k, str):
                    out[-1] += k
                else:
                    go(k)
            out.extend([""] * block)

        go(n)
        return [y for x in out if (y := " ".join(x.split()))]

    scored = [n for n in order if id(n) in points]
    if not scored:
        return 0.0, ""
    best = max(score(n) for n in scored)
    top = next(n for n in scored if score(n) == best)
    kept = []
    for n in [k for k in top["up"]["kids"] if not isinstance(k, str)] if top["up"] else [top]:
        size = sum(map(len, texts(n)))
        good = n is top or id(n) in points and score(n) >= max(10, H.SIBLING * best)
        if n["tag"] == "p" and not good:
            good = density(n) < 0.25 if size > 80 else size > 0 and density(n) == 0 and " ".join(lines(n))[-1:] in list(".!?")
        kept += lines(n) if good else []
    return round(best, 6), "\n".join(kept)


@pytest.mark.parametrize("html", [
    f"<div><div><p>{LONG * 3}</p><p>{LONG}</p></div><div><p><a>{LONG}</a></p></div></div>",
    f"<div><p>{LONG}</p></div><div><div><div><div><p>{LONG}</p></div></div></div></div>",
    f"<div><p>short</p><p><span>{LONG}</span><a>link, text</a></p></div>",
    "<div>nothing</div>",
])
def test_score_equals_naive(html):
    assert (H.extract(html)[2], H.extract(html)[1]) == naive(html)


def test_random_pages_equal_naive():
    r = random.Random(11)

    def sentence(n):
        return " ".join(r.choice(("word", "and,", "more", "of", "a", "text,", "long")) for _ in range(n)) + r.choice((".", "", "!"))

    def inline():
        return r.choice((lambda: sentence(r.randint(1, 40)), lambda: f"<a href='x'>{sentence(r.randint(1, 20))}</a>", lambda: f"<span>{sentence(r.randint(1, 9))}</span>"))()

    def block(depth):
        if depth == 0 or r.random() < 0.5:
            return "<p>" + " ".join(inline() for _ in range(r.randint(0, 4))) + "</p>"
        tag = r.choice(("div", "nav", "div"))
        return f"<{tag}>" + "".join(block(depth - 1) for _ in range(r.randint(0, 5))) + f"</{tag}>"

    for _ in range(400):
        html = "<div>" + "".join(block(4) for _ in range(r.randint(1, 5))) + "</div>"
        assert (H.extract(html)[2], H.extract(html)[1]) == naive(html), html


@pytest.mark.parametrize("tag", ["button", "select", "svg", "iframe", "object", "noscript", "template", "math"])
def test_elements_that_are_left_out(tag):
    text = f"<p>{LONG}</p>"
    assert H.extract(f"<div>{text}<{tag}>gone</{tag}>{text}</div>")[1].split("\n") == [LONG.strip()] * 2
    kept = H.extract(f"<div><div><{tag}>note</div>{text}{text}</div>")[1]
    assert kept.count(LONG.strip()) == 2  # never closed
    closed = H.extract(f"<div><span><{tag}>gone</span>{text}</div><div><{tag}>x</{tag}></div>")[1]
    assert LONG.strip() in closed and "gone" not in closed  # ends at its parent
    assert LONG.strip() in H.extract(f"<div><{tag} />{text}</div>")[1]


def test_container_and_siblings():
    html = f"<body><nav><a href=x>one</a> <a>two</a></nav><div id=main><p>{LONG * 3}</p><p>{LONG * 2}</p></div><p>A closing remark.</p><p><a>only a link, which is left out</a></p><div>ad text that is long enough, but alone</div></body>"
    title, text, score, n = H.extract("<title>A  title</title>" + html)
    assert title == "A title" and score > 0
    assert text.split("\n") == [(LONG * 3).strip(), (LONG * 2).strip(), "A closing remark."]


def test_mended_markup():
    html = f"<!doctype html><script>var x = '<p>no</p>';</script><div><p>{LONG}<p>{LONG}&amp; &eacute;<br>after<ul><li>{LONG}<li>b</ul><!-- {LONG} --></div></b></p>"
    _, text, _, n = H.extract(html)
    assert "no" not in text.split() and "& é" in text and n == 2
    assert text.split("\n")[2] == "after"


def test_attributes_with_signs():
    assert H.extract(f'<div title="a > b"><p>{LONG}</p></div>')[1] == LONG.strip()
    assert H.extract(f"<div title='a><p>{LONG}</p></div>")[2] > 0


@pytest.mark.parametrize("html", ["", " ", "<", "<<<<", "<a" * 3000, "<div>" * 5000 + LONG, "<p>" * 5000, "</p>" * 5000, "<script>", "<!--", "&#xd800; &bogus;", "x" * 200_000, "<td>" * 2000])
def test_odd_pages_do_not_fail(html):
    title, text, score, n = H.extract(html)
    assert score >= 0 and n >= 0


def test_pages(spark):
    rows = [(1, "u", f"<div><p>{LONG}</p></div>"), (2, None, None), (None, "u", ""), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, title string, text string")
    out = H.extract_pages(pages)
    got = sorted(((r["page_id"], r["text"], r["score"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, LONG.strip(), naive(rows[0][2])[0]), (2, None, None), (None, "", 0.0), (3, "", 0.0), (3, "", 0.0)], key=repr)
    assert H.extract_pages(pages.limit(0)).count() == 0
