"""HTML extraction against pages whose article is known."""

import html
import random

import pytest

from leafmill.llm import extraction, markup

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."


def named(rng, i):
    """A page whose parts are named."""
    paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
    items = "".join(f'<li><a href="/{k}">{words(rng, 2)}</a></li>' for k in range(5))
    body = "".join(f"<p>{p.replace('a', '&#97;', 1)}" + rng.choice(["</p>", "\n"]) for p in paragraphs)
    title = words(rng, 5)
    page = (
        f"<!doctype html><html><head><title>{title}</title><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style></head><body><header><h2>The site</h2></header>"
        f"<nav><ul>{items}</ul></nav><div class='cookie-notice'>We use {words(rng, 3)}</div><!-- <p>none</p> --><article><h1>{title}</h1>{body}"
        f"<div class='ad-slot'>{words(rng, 9)}</div></article><aside>{words(rng, 30)}</aside><section id='comments'><p>{words(rng, 40)}</p><p>{words(rng, 40)}</p></section>"
        f"<form><label>Name</label><input><button>Send</button></form><footer>&copy; {words(rng, 6)}</footer></body></html>"
    )
    return page, [title, *paragraphs]


def nameless(rng, i):
    """A page of bare divs: the template alone tells its parts."""
    paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
    title = words(rng, 5)
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = (
        f"<html><body><div class=q1><div><a href=/>Home</a> <a href=/b>All posts</a></div><span>Site of the week</span></div>"
        f"<div class=q2><div class=q3>{words(rng, 4)}</div><div class=q4><h1>{title}</h1><p>Sign in to save this page</p>{body}</div></div>"
        f"<div class=q5>Made by hand since long ago</div></body></html>"
    )
    return page, [title, *paragraphs]


def flat(rng, i):
    """A page without any wrapper around its text."""
    paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    page = f"<body><nav><a href=/>Home</a></nav><h1>{paragraphs[0]}</h1>" + "<br><br>".join(f"<p>{p}</p>" for p in paragraphs[1:]) + "<div id=footer>Footer text</div>"
    return page, paragraphs


@pytest.mark.parametrize("make", [named, nameless, flat])
def test_articles(spark, make):
    rng = random.Random(4)
    made = [make(rng, i) for i in range(30)]
    rows = [(i, f"https://host.example/{i}", page) for i, (page, _) in enumerate(made)]
    found = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, parts) in enumerate(made):
        assert found[i]["text"] == "\n".join(parts)
        assert found[i]["n_chars"] == len(found[i]["text"]) and found[i]["url"] == rows[i][1]


def test_hosts_do_not_mix(spark):
    """Each host has a template of its own, also beside one of a third of all rows; one more partitioning gives the same."""
    rng = random.Random(7)
    made = [(named, nameless, flat)[i % 3](rng, i) for i in range(60)]
    rows = [(i, f"http://h{i % 3}.example/{i}", page) for i, (page, _) in enumerate(made)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, extraction.extract(df.repartition(7)).collect()))
    assert one == sorted(map(tuple, extraction.extract(df.coalesce(1)).collect()))
    assert [r[2] for r in one] == ["\n".join(parts) for _, parts in made]


def test_supplied_pages(spark):
    """The supplied pages hold one article of p, h1, b and br each."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extraction.extract(pages).collect():
        article = re.search("<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_edge_cases(spark):
    long = "<article>" + "<p>lorem ipsum dolor</p>" * 30_000 + "</article>"
    rows = [
        (1, "http://a.example/", None), (2, None, ""), (None, "http://a.example/x", "<p>one<p>two"), (4, "nonsense", "plain  text \n here"),
        (5, "http://b.example/", "<p>same</p>"), (5, "http://b.example/", "<p>same</p>"), (6, "http://long.example/", long), (7, "http://c.example/", "<div>" * 5000 + "deep"),
        (8, "http://d.example/", "a < b &amp; c &lt; d <p title='x>y'>e</p><p title='never"), (9, "http://e.example/", "<script>x</script><!-- y"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, host int")
    found = sorted(((r["page_id"] or 0, r["text"]) for r in extraction.extract(df).collect()), key=str)
    assert dict(found[:2] + found[3:]) is not None and len(found) == len(rows)
    by_id = {}
    for i, text in found:
        by_id.setdefault(i, []).append(text)
    assert by_id[1] == [""] and by_id[2] == [""] and by_id[0] == ["one\ntwo"] and by_id[4] == ["plain text here"] and by_id[5] == ["same", "same"]
    assert by_id[6] == ["\n".join(["lorem ipsum dolor"] * 30_000)] and by_id[7] == ["deep"] and by_id[8] == ["a < b & c < d\ne"] and by_id[9] == [""]
    assert extraction.extract(df.limit(0)).count() == 0


def test_same_article_on_all_pages_is_no_template(spark):
    page = "<body><div class=m><a href=/>Home</a></div><div class=t><p>The only article that this host has, on every page.</p><p>And more of it.</p></div></body>"
    found = extraction.extract(spark.createDataFrame([(i, "http://copies.example", page) for i in range(5)], SCHEMA)).collect()
    assert {r["text"] for r in found} == {"The only article that this host has, on every page.\nAnd more of it."}


def test_nodes_and_links():
    items = list(markup.read("<ul><li>a<li><a href=x>b <b>c</b></a> d</ul>e"))
    assert [(t.text, t.link) for t in items if isinstance(t, markup.Text)] == [("a", False), ("b ", True), ("c", True), (" d", False), ("e", False)]
    nodes = [n for n in items if isinstance(n, markup.Node)]
    assert nodes[1].id == nodes[2].id and nodes[1].parent == nodes[0].id
