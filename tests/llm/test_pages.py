"""Main text of pages without names to go by, of several containers, and of odd form."""

import random
import re
import time

import duckdb
import pytest

from pairlattice.llm import html_text

WORDS = "the light of a long day went over hills and into towns where people met, talked and slept until morning".split()


def para(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randint(15, 60))).capitalize() + "."


def page(rng, wrap, named=True):
    """A page and its article's lines."""
    name = lambda x: f' class="{x}"' if named else ""
    menu = lambda n: "".join(f"<li><a href=/x{i}>{rng.choice(WORDS)}</a></li>" for i in range(n))
    blocks = [("h1", para(rng, 5)[:-1])] + [("p", para(rng)) for _ in range(rng.randint(3, 8))] + [("h2", "A part")] + [("p", para(rng)) for _ in range(rng.randint(2, 5))] + [("p", "Yes.")]
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    half = body.index("<h2>")
    rest = f"<nav><ul>{menu(6)}</ul></nav><div{name('crumbs')}><a>Home</a> / <a>Log</a></div>"
    after = f"<div{name('more')}><ul>{menu(8)}</ul></div><footer>(c) all of it, and more. And so on.</footer>"
    return f"<html><body>{rest}{wrap(body[:half], body[half:], name)}{after}</body></html>", [x for _, x in blocks]


WRAPS = {
    "article": lambda a, b, name: f"<article>{a}{b}</article>",
    "named": lambda a, b, name: f"<div{name('post')}>{a}{b}</div>",
    "two": lambda a, b, name: f"<div{name('left')}>{a}</div><div{name('right')}>{b}</div>",
    "nested": lambda a, b, name: f"<div{name('wrap')}><div>{a}<div{name('tags-explained')}>{b}</div></div></div>",
    "sections": lambda a, b, name: f"<main><section>{a}</section><section>{b}</section></main>",
    "table": lambda a, b, name: f"<table><tr><td><ul><li>x</li></ul></td><td>{a}{b}</td></tr></table>",
}


@pytest.mark.parametrize("named", [True, False])
@pytest.mark.parametrize("wrap", sorted(WRAPS))
def test_articles_without_their_names(wrap, named):
    rng = random.Random(wrap)
    for _ in range(30):
        html, lines = page(rng, WRAPS[wrap], named)
        assert html_text.extract(html).split("\n") == lines


def test_renamed_elements_of_the_tables_pages():
    rows = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    for (html,) in rows:
        assert html_text.extract(html.replace("<article>", "<div>").replace("</article>", "</div>")) == html_text.extract(html)


def test_content_paths_decide(monkeypatch):
    rng = random.Random(1)
    pages = [page(rng, WRAPS[w])[0] for w in sorted(WRAPS) for _ in range(20)]
    pages += [r[0] for r in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    before = [html_text.extract(x) for x in pages]
    monkeypatch.setattr(html_text, "_content_paths", lambda order, *_: {rng.choice(sorted(set(order)))})
    assert sum(html_text.extract(x) != y for x, y in zip(pages, before)) > 0.7 * len(pages)
    monkeypatch.setattr(html_text, "_content_paths", lambda order, *_: set(order))
    assert sum(html_text.extract(x) != y for x, y in zip(pages[:120], before)) > 60


def test_ratios_by_plain_sums():
    order = [1, 2, 2, 3, 2, 1]
    length, marks, free = {1: 4.0, 2: 200.0, 3: 30.0}, {1: 0.0, 2: 5.0, 3: 1.0}, {1, 2, 3}
    weights = [0.1353352832366127, 0.6065306597126334, 1.0, 0.6065306597126334, 0.1353352832366127]

    def smooth(of):
        out = []
        for i, p in enumerate(order):
            near = [(j, w * (1 if order[j] == p else 0.25)) for j, w in zip(range(i - 2, i + 3), weights) if 0 <= j < len(order)]
            out.append(sum(w * of[order[j]] for j, w in near) / sum(w for _, w in near))
        return [x / max(out) for x in out]

    fused = [(x * (y + 0.05)) ** 0.5 for x, y in zip(smooth(length), smooth(marks))]
    mid = sum(fused) / 6
    level = html_text.LEVEL * (sum((x - mid) ** 2 for x in fused) / 6) ** 0.5
    want = {p for p in (1, 2, 3) if sum(x for x, q in zip(fused, order) if q == p) / order.count(p) >= level}
    assert html_text._content_paths(order, length, marks, free) == want


@pytest.mark.parametrize("piece", ["<a '", "<div>x", "<div>x</span>", "<p><b><i>x", "<ul><li>x", "<!--", '<a href="', "<", "<a 'x>y", "<td>x", "</div>"])
def test_odd_pages_take_linear_time(piece):
    def seconds(n):
        text = piece * (n // len(piece))
        start = time.process_time()
        html_text.extract(text)
        return time.process_time() - start

    seconds(10_000)
    small, large = seconds(125_000), seconds(1_000_000)
    assert large < 16 * small + 1.0 and large < 15
    assert re.sub(r"\s", "", html_text.extract("<a 'x" + "<p>some text")) == "sometext"


BODY = "<p>Body text of the article, with more. It goes on and on, for a line or two.</p>" * 6


@pytest.mark.parametrize("html, want", [
    ("<div class=post><h1>Title</h1><ul>" + "".join(f"<li>item {i}</li>" for i in range(20)) + "</ul></div><div><p>" + "This is one long notice, with much text. It goes on. " * 8 + "</p></div>", ["Title", *(f"item {i}" for i in range(20))]),
    ("<div><p>We use cookies, and more of them. You can accept, or not accept, all of them here today.</p></div><article><h1>Short</h1><p>A short one.</p></article>", ["Short", "A short one."]),
    ("<div><ul><li><a>Home</a></li><li><a>News</a></li><li><a>Log</a></li></ul></div><div><h1>T</h1>" + BODY + "</div><div><p>Copyright, terms</p></div>", ["T", *re.findall("<p>(.*?)</p>", BODY)]),
    ("<article><h1>T</h1>" + BODY + "</article><div><p>I think, so it is. Good text, that is long enough.</p><p>Me too, I do. It is fine, and well.</p></div>", ["T", *re.findall("<p>(.*?)</p>", BODY)]),
    ("<article><h1>T</h1><h2 id=advert>Advert</h2>" + BODY + "</article>", ["T", "Advert", *re.findall("<p>(.*?)</p>", BODY)]),
], ids=["short items", "cookies", "copyright", "replies", "heading"])
def test_what_stands_beside_an_article_stays_out(html, want):
    assert html_text.extract(f"<html><body>{html}</body></html>").split("\n") == want


def test_ratios_alone_leave_out_what_names_no_longer_tell(monkeypatch):
    rows = [r[0] for r in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    bare = [re.sub(r"(?i)<(/?)(article|nav|header|footer|aside|form)\b", r"<\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h)) for h in rows]
    before = [html_text.extract(h) for h in bare]
    named = [html_text.extract(h) for h in rows]
    assert all(set(x.split("\n")) <= set(y.split("\n")) for x, y in zip(named, before)) or sum(x == y for x, y in zip(named, before)) > 0.2 * len(rows)
    monkeypatch.setattr(html_text, "_content_paths", lambda order, *_: set(order))
    assert sum(html_text.extract(h) != x for h, x in zip(bare, before)) > 0.95 * len(rows)


def brute_staying(nodes, runs, content, able):
    """What stays, by its definition: every sum is taken over all runs anew."""
    above = lambda node: [node] + (above(node.parent) if node.parent is not None else [])
    around = [above(node) for node, _, _ in runs]
    size = [len(text.strip()) * a for (_, text, _), a in zip(runs, able)]
    good = [n > 0 and node.path in content for (node, _, _), n in zip(runs, size)]
    total = lambda x, only: sum(n for n, g, up in zip(size, good, around) if x in up and (g or not only))
    reaches = lambda x, share: total(x, True) > 0 and total(x, True) >= share * total(x, False)
    mostly = {x: x.tag not in html_text.PAGE and reaches(x, html_text.SHARE) for x in nodes}
    tops = {x for x in nodes if x.tag == "article" and reaches(x, html_text.SAID_SHARE)} | {node.container for (node, _, _), g in zip(runs, good) if g and mostly[node.container]}
    held = lambda up, tops: any(x in tops for x in up)
    foreign = [n and not held(up, tops) and node.block.tag not in html_text.MILD for (node, _, _), n, up in zip(runs, size, around)]
    wide = tops | {x for x in nodes if mostly[x] and not any(f and x in up for f, up in zip(foreign, around))}
    loose = [i for i, ((node, _, _), g) in enumerate(zip(runs, good)) if g and node.container.tag in html_text.PAGE]
    blocks = {b for (_, _, b), g in zip(runs, good) if g}
    out = []
    for i, (node, _, block) in enumerate(runs):
        beside = bool(loose) and node.container.tag in html_text.PAGE and (node.block.tag in html_text.MILD or loose[0] <= i <= loose[-1])
        out.append(bool(able[i] and (held(around[i], wide) or block in blocks or beside)))
    return out


def test_selection_by_brute_force():
    rng = random.Random(12)
    tags = "div p article section ul li h2 a b td main span".split()

    def tree(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(tags)
            inner = tree(depth - 1) if depth and rng.random() < 0.6 else para(rng, rng.randint(1, 12))
            out += f"<{tag}{rng.choice(['', ' class=x', ' class=advert'])}>{inner}</{tag}>" + (para(rng, 2) if rng.random() < 0.2 else "")
        return out

    for _ in range(300):
        page = html_text._Page(f"<html><body>{tree(3)}</body></html>")
        paths = sorted({node.path for node, _, _ in page.runs})
        content = set(rng.sample(paths, rng.randint(0, len(paths))))
        able = [not node.out and rng.random() < 0.9 for node, _, _ in page.runs]
        assert [bool(x) for x in html_text._staying(page.nodes, page.runs, content, able)] == brute_staying(page.nodes, page.runs, content, able)
