import html
import random
import re
import time

from churnlens.llm import catalog, html_text

from .helpers import SF

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        left, right = html_text.shared(a, b)
        assert [a[i] for i in left] == [b[j] for j in right] and len(left) == lcs(a, b)
        assert left == sorted(set(left)) and right == sorted(set(right))


def test_lines():
    read = lambda s: [t for t, k in html_text.lines(s) if k != html_text.CHROME]
    assert read("<p>a &amp; b<p>c<br>d  <b>e</b>f") == ["a & b", "c d ef"]
    assert read("<script>var t='</p><p>x';</script>x<style>p{}</style><!-- <p>no -->y") == ["xy"]
    assert read("<nav><ul><li>m<li>n</ul></nav><p>t</p><footer>f</footer>") == ["t"]
    assert read('<div class="cookie-notice"><p>c<p>d</div><p>t') == ["t"]
    assert read('<div class="uploads admin">kept</div>') == ["kept"]             # not an advert
    assert read('<p class="ad">x<p>kept') == ["kept"]
    assert read('<a title="1 > 0">t</a> 5 < 6 &lt;b&gt;') == ["t 5 < 6 <b>"]
    assert read("<div>unclosed <aside>s</aside> more") == ["unclosed", "more"]
    assert read("") == read("<p> &nbsp;\n</p>") == read("<script>never ended") == []
    assert read("<form><p>x</p></form><select><option>o</select><button>b</button>t") == ["t"]


def test_article_lines_stay_though_shared_and_chrome_goes(spark):
    page = "<nav>m</nav><article><h1>Same</h1><p>copied text</p><div class='comments'>nice</div></article><p>beside"
    assert texts(spark, [(1, "http://h/a", page), (2, "http://h/b", page)]) == \
        {1: "Same\ncopied text\nbeside", 2: "Same\ncopied text\nbeside"}    # copies have no other page to compare with


def test_pages_without_an_article_lose_what_their_neighbours_share(spark):
    page = lambda i: f"<div>Site name</div><div>We use cookies</div><p>own text {i}</p><p>more {i}</p><div>Contact us</div>"
    rows = [(i, f"http://h/p/{i:03d}?q={i % 3}", page(i)) for i in range(40)] + [(100, "http://alone/", page(100)), (101, None, "<p>no url"), (102, "http://H/zz", "<p>last")]
    got = texts(spark, rows)
    assert all(got[i] == f"own text {i}\nmore {i}" for i in range(40))
    assert got[100] == "Site name\nWe use cookies\nown text 100\nmore 100\nContact us"
    assert got[101] == "no url" and got[102] == "last"


def test_edge_rows(spark):
    long = "<p>" + "word " * 50_000
    rows = [(1, "http://h/", None), (2, "http://h/", ""), (3, "", "<nav>x</nav>"), (4, "http://g/", long), (5, "http://h/", "<p>twice"), (5, "http://h/", "<p>twice"), (None, "x", "<main>t")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as row", "2 as keys", "'y' as main", "'z' as text", "3 as host", "4 as at")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()))
    # a page stored twice is compared as one page: it keeps its text
    assert got == [(0, "t"), (1, ""), (2, ""), (3, ""), (4, ("word " * 50_000).strip()), (5, "twice"), (5, "twice")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_query_against_the_article_element(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.op6_html(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_open_lines_beside_an_article_element_are_decided_by_the_neighbours(spark):
    page = lambda i: f"<div>Site name</div><p>body {i}</p><article>teaser {i}</article><p>more {i}</p><div>Contact us</div>"
    rows = [(i, f"http://h/{i:02d}", page(i)) for i in range(20)]
    # nothing to compare with: nothing says that what stands beside the article is no part of the text
    rows += [(50, "http://a/", "<p>beside<main>the text of the page</main>"), (51, "http://b/", "<p>the text of the page<main class='main'>card</main>")]
    got = texts(spark, rows)
    assert all(got[i] == f"body {i}\nteaser {i}\nmore {i}" for i in range(20))
    assert got[50] == "beside\nthe text of the page" and got[51] == "the text of the page\ncard"


def test_copies_keep_their_text(spark):
    page = lambda i: f"<div>Site name</div><p>own text {i}</p><div>Contact us</div>"
    rows = [(10 * i + c, f"http://h/p/{i:02d}?id={c}", page(i)) for i in range(8) for c in range(4)]
    rows += [(100, "http://h/mirror/3", page(3)), (101, "http://g/a", page(1)), (102, "http://g/b", page(1)), (103, "http://h/p/03", None)]
    got = texts(spark, rows)
    assert all(got[10 * i + c] == f"own text {i}" for i in range(8) for c in range(4)) and got[100] == "own text 3"
    assert got[101] == got[102] == "Site name\nown text 1\nContact us"          # no other page to compare with
    assert got[103] == ""


def test_halved_alignments_are_as_long(monkeypatch):
    monkeypatch.setattr(html_text, "FEW_MATCHES", 3)
    test_alignment_is_a_longest_common_subsequence()
    rng = random.Random(6)
    for n in (40, 150):
        a, b = ([rng.choice("aaab") for _ in range(n)] for _ in range(2))
        left, right = html_text.shared(a, b)
        assert [a[i] for i in left] == [b[j] for j in right] and len(left) == lcs(a, b)
        assert left == sorted(set(left)) and right == sorted(set(right))


def test_many_equal_lines_are_aligned_in_seconds():
    """Two tables of 50,000 rows, nearly all alike."""
    rng = random.Random(7)
    a, b = ([rng.choice([0] * 50 + [1, 2]) for _ in range(50_000)] for _ in range(2))
    began = time.process_time()
    left, right = html_text.shared(a, b)
    assert time.process_time() - began < 60
    assert [a[i] for i in left] == [b[j] for j in right] and left == sorted(set(left)) and right == sorted(set(right))
    assert len(left) >= 0.96 * 50_000
    left, right = html_text.shared([0] * 50_000, [0] * 40_000 + [1])
    assert len(left) == 40_000


def test_pairing_and_deletion_against_brute_force(spark):
    """Copies reduced, neighbours by path within a host, open lines shared with either one deleted."""
    rng = random.Random(11)
    blocks = [f"line {i}" for i in range(12)]
    rows = []
    for i in range(120):
        page = [rng.choice(blocks) for _ in range(rng.randint(1, 6))] if i % 10 else ["the same page", "twice"]
        article = rng.random() < 0.3
        body = "".join(f"<p>{b}</p>" for b in page) + (f"<article><p>{rng.choice(blocks)}</p></article><p>{rng.choice(blocks)}</p>" if article else "")
        rows.append((i, f"https://h{i % 3}/{rng.random():.9f}?x={i}", body))
    hosts = {}
    for i, url, body in rows:
        path = url.split("/", 3)[3].split("?")[0]
        hosts.setdefault(url.split("/")[2], {}).setdefault(tuple(t for t, _ in html_text.lines(body)), []).append((path, i))
    want = {}
    for of in hosts.values():
        order = sorted((min(copies), page) for page, copies in of.items())
        gone = [set() for _ in order]
        for k in range(1, len(order)):
            left, right = html_text.shared(list(order[k][1]), list(order[k - 1][1]))
            gone[k].update(left)
            gone[k - 1].update(right)
        for (_, page), out in zip(order, gone):
            for _, i in of[page]:
                kinds = [k for _, k in html_text.lines(rows[i][2])]
                want[i] = "\n".join(t for j, (t, k) in enumerate(zip(page, kinds)) if k == html_text.ARTICLE or j not in out)
    assert sum(len(t) for t in want.values()) < sum(len(t) for of in hosts.values() for page, c in of.items() for t in page for _ in c)
    assert texts(spark, rows) == want
