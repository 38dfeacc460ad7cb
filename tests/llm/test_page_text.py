"""op11 on pages whose template is planted, with and without telling names, and on odd ones."""

import random

import pytest
from pyspark.sql import functions as F

from symweave.llm import page_text

WORDS = "alder birch cedar fir hazel larch maple oak pine rowan spruce willow yew elm".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def soup(k, rng, host="plain.example.org"):
    """No telling names: only the pages of the host tell menu, notes and foot from the slot."""
    own = [prose(rng, 20 + rng.randrange(30)) for _ in range(1 + rng.randrange(4))]
    body = "".join(f"<div>{p}</div>" for p in own)
    page = (
        f'<html><body><div class="k1"><ul><li><a href="/a">Start here</a><li><a href="/b">All trees</a></ul></div><table><tr><td class="k2">{prose(rng, 3)}</td>'
        f'<td class="k3">{body}<div>Printed on recycled paper</div></td></tr></table><div class="k4">Trees of the world since 1901</div></body></html>'
    )
    return (k, f"http://{host}/{k}", page), "\n\n".join(own)


def run(spark, rows):
    got = page_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(len(r.text) == r.n_chars for r in got)
    return {r.page_id: r.text for r in got}


def test_slots_of_a_template_without_telling_names(spark):
    rng = random.Random(1)
    made = [soup(k, rng) for k in range(30)]
    got = run(spark, [m[0] for m in made])
    assert got == {m[0][0]: m[1] for m in made}


def test_hosts_are_apart_and_few_pages_make_no_template(spark):
    rng = random.Random(2)
    made = [soup(k, rng, "a.example.org") for k in range(9)] + [soup(100 + k, rng, "b.example.org") for k in range(3)]
    got = run(spark, [m[0] for m in made])
    for row, text in made[:9]:
        assert got[row[0]] == text
    for row, text in made[9:]:  # three pages: the line under the text is not known to be the template's
        assert got[row[0]] == text + "\n\nPrinted on recycled paper"


def test_copies_keep_their_text(spark):
    row, _ = soup(0, random.Random(3))
    article = f'<html><body><nav>Menu</nav><article><h1>One</h1><p>{prose(random.Random(4), 60)}</p></article></body></html>'
    got = run(spark, [(k, f"http://c.example.org/{k}", article) for k in range(20)])
    assert set(got.values()) == {"One\n\n" + prose(random.Random(4), 60)}


PARTS = [
    ("<p>A &amp; B&nbsp;&lt;c&gt; &#233;&#x4e2d;</p>", "A & B <c> é中"),
    ("<p>one<br>two</p><p>three", "one two\n\nthree"),
    ("<P>x<b>y</b>z <i>w</P>", "xyz w"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ('<p>a</p><div class="share-buttons">Share</div><p>b</p>', "a\n\nb"),
    ('<p>a</p><section id="comments"><article class="comment"><p>nice</p></article></section>', "a"),
    ("<p>a</p><form><p>Mail</p><input></form><aside>more</aside><script>if (1 < 2) '</p>'</script><style>p{}</style>", "a"),
    ('<header><h2>Title</h2><p>by me</p></header><p>a</p><div style="display: none">no</div><p hidden>no</p>', "Title\n\na"),
    ('<p>a <span class="ad">buy</span> b <a href="/x">link</a></p><!-- <p>no</p> --><div role="navigation">no</div>', "a b link"),
    ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
    ('<p title="a > b">a</p><p class=cookie-notice>no</p><p class="loader">loader</p>', "a\n\nloader"),
]


@pytest.mark.parametrize("part, text", PARTS)
def test_pieces(part, text):
    page = page_text.Page(f'<!doctype html><html><head><title>no</title></head><body class="has-sidebar"><nav>no</nav><header>no<h1>Site</h1></header><main><article>{part}</article></main><footer>no</footer>')
    assert page.text(page.main(), frozenset()) == text


def test_odd_pages(spark):
    rows = [
        (0, None, None), (1, "http://x.example.org/", ""), (2, "not an address", "<p>lone</p>"), (3, None, "no markup at all"), (None, "", "<div><p>a</p></div>"), (4, "HTTP://U@X.example.org:80/?q", "<div>" * 50_000 + "deep"),
        (5, "//x", "<p"), (6, "http://x/", "<div class='a>b</div><p>c</p>"), (7, "http://x/", "<p>" + "word " * 200_000), (7, "http://x/", "</p></div>  \n\t "), (8, "http://x/", "<article></article><nav>only a menu</nav>"), (9, "http://x/", '<a "' * 3_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_text.extracted(df)
    plain = sorted(map(repr, got.collect()))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and len(plain) == len(rows)
    more = df.withColumns({c: F.lit(1) for c in ("host", "n", "main", "fixed", "token", "text", "met")})
    assert sorted(map(repr, page_text.extracted(more).collect())) == plain
    text = {(r.page_id, r.url): r.text for r in got.collect() if r.page_id != 7}
    assert text[0, None] == text[1, "http://x.example.org/"] == "" and text[2, "not an address"] == "lone" and text[3, None] == "no markup at all" and text[None, ""] == "a"
    assert text[4, "HTTP://U@X.example.org:80/?q"] == "deep" and text[8, "http://x/"] == ""
    assert page_text.extracted(df.limit(0)).count() == 0
