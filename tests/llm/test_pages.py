"""Html extraction, archives and url rules."""

import gzip
import hashlib
import json
import html as escapes
import re
from collections import defaultdict

import numpy as np
import pytest

from millwatch.llm import entry, html_extract, url_filter, warc
from millwatch.llm.html_extract import extract, main_text
from millwatch.llm.storage import table

SF = "/root/testdata/sf0.001"


def test_op1(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    got = entry.op1_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(escapes.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


BODY = "Long text here is a body of words that go on and on for a while, and then some more of them."
PAGES = {
    f"<p>{BODY}</p>": BODY,
    f"<body><header>Site</header><div class='cookie-notice'>We use cookies</div><div><h1>T</h1><p>{BODY}<p>More &amp;&#32;more</div><aside>side</aside>": f"T\n{BODY}\nMore & more",
    f"<nav>{'<a href=x>menu item</a>' * 30}</nav><main><p>{BODY}</p><form>Search<input></form><p>b</p></main><footer>{BODY * 2}</footer>": f"{BODY}\nb",
    f"<article><p>{BODY}</p><p>x\n\t y</p></article><section class='comments'><article>{BODY * 3}</article></section>": f"{BODY}\nx y",
    f"<div class=ad>Buy now<article><h1>a</h1><p>{BODY}</p></article>": f"a\n{BODY}",
    f"<article><header><h1>Title</h1><span>by x</span></header><p>{BODY}</p></article>": f"Title\n{BODY}",
    f"<p>{BODY} one<button>Share</button> two<span class='share'>x</span><script>1</script> three</p><p>b</p>": f"{BODY} one two three\nb",
    "no tags at all": "no tags at all",
    f"<script>var t = '<p>no</p>'</script><style>p{{}}</style><p>{BODY}<!-- {BODY} -->": BODY,
    "": "",
    "<p></p>": "",
    "<![if": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page).replace("<![if", "") == PAGES[page]


WRAPPED = {
    f"<body><form id=aspnet><nav>menu</nav><h1>T</h1><p>{BODY}</p><p>{BODY}</p><input></form>": f"T\n{BODY}\n{BODY}",
    f"<article class='post has-reply'><p>{BODY}</p><form>Search<input></form></article>": BODY,
    f"<body class='single comments-open'><p>{BODY}</p><p>b</p>": f"{BODY}\nb",
    f"<body><div class='layout has-sidebar'><div class='sidebar'>{'<a href=x>item</a>' * 9}</div><div><h1>T</h1><p>{BODY}</p><p>{BODY}</p></div></div>": f"T\n{BODY}\n{BODY}",
    f"<div id='content' class='with-banner'><div class=banner>Buy now</div><p>{BODY}</p><p>b</p></div>": f"{BODY}\nb",
    f"<x-page class='share-page'><p>{BODY}</p><p>{BODY}<span class='share'>x</span></p></x-page>": f"{BODY}\n{BODY}",
    f"<body class='post comments-open'><div><p>{BODY}</p><p>b</p></div><div class=comments><p>{BODY * 3}</p><p>{BODY * 3}</p></div>": f"{BODY}\nb",
    f"<div class='has-sidebar'><nav>menu</nav><p>{BODY}</p><p>{BODY}</p><div class=related><p>{BODY}</p></div></div>": f"{BODY}\n{BODY}",
    f"<article><p>{BODY}</p></article><div class=related><p>{BODY * 3}</p><p>{BODY * 3}</p></div>": BODY,
    f"<div><p>{BODY}</p></div><div class=comments><p>{BODY * 30}</p></div>": BODY,
}


@pytest.mark.parametrize("page", WRAPPED)
def test_ratios_overrule_names(page):
    assert main_text(page) == WRAPPED[page]


HINTED = {
    f"<article><p>{BODY}</p><div class='share-of-market'><p>{BODY}</p></div><p>end</p></article>": f"{BODY}\n{BODY}\nend",
    f"<article><p>{BODY}</p><p class='notice-period'>The notice period is four weeks.</p><p>{BODY}</p></article>": f"{BODY}\nThe notice period is four weeks.\n{BODY}",
    f"<article><p>{BODY * 3}</p><div class='related-work'><h2>Related work</h2><p>{BODY}</p></div><p>{BODY}</p></article>": f"{BODY * 3}\nRelated work\n{BODY}\n{BODY}",
    f"<article><p>{BODY * 2}</p><p>{BODY * 2}</p><div class='share-the-love'><a>fb</a><a>x</a><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div></article>": f"{BODY * 2}\n{BODY * 2}",
    f"<article><p>{BODY}</p><div class='share-buttons'><p>{BODY}</p></div><div class='advert-acme'><p>{BODY}</p></div><div id='relatedPosts'><p>{BODY}</p></div></article>": BODY,
    f"<article><p>{BODY}</p><div class='reply-brief big'><p>{BODY}</p></div></article>": f"{BODY}\n{BODY}",
}


@pytest.mark.parametrize("page", HINTED)
def test_names_that_hint_are_weighed(page):
    assert main_text(page) == HINTED[page]


LINKS = "".join(f"<div><a href=/{k}>Item {k}</a> <a href=/x{k}>more</a></div>" for k in range(12))
UNNAMED = {
    f"<body><div>{LINKS}</div><div><h1>T</h1><p>{BODY}</p><p>{BODY}</p></div><div>{LINKS}</div></body>": f"T\n{BODY}\n{BODY}",
    f"<table><tr><td>{LINKS}</td><td><p>{BODY}</p><p>b</p><p>{BODY}</p></td><td>{LINKS}</td></tr></table>": f"{BODY}\nb\n{BODY}",
    f"<div id=page><div>{LINKS}</div><div><div><h2>A</h2><p>{BODY}</p></div><div><h2>B</h2><p>{BODY}</p></div></div><div><span>a</span><span>b</span></div>{LINKS}</div>": f"A\n{BODY}\nB\n{BODY}",
}


@pytest.mark.parametrize("page", UNNAMED)
def test_ratios_decide_where_parts_have_no_names(page, monkeypatch):
    assert main_text(page) == UNNAMED[page]
    monkeypatch.setattr(html_extract, "clustered", lambda ratios: np.ones(len(ratios), bool))
    assert main_text(page) != UNNAMED[page]


@pytest.mark.parametrize("mark", ["<![foo]>", "<![foo[x]]>", "<![ endif]>", "<![]>", "<![endif]-->", "<![if !IE]>", "<![CDATA[x]]>", "<![-x", "<![9 a='b'>", "<!foo>", f"&#{'9' * 5000};", f"&#{'0' * 5000}32;"])
def test_text_after_marks(mark):
    end = "" if mark.endswith((">", ";")) else ">"
    assert main_text(f"<p>{BODY}</p>{mark}{end}<p>{BODY}</p>").replace("\n\ufffd", "") == f"{BODY}\n{BODY}"


def test_extract_edges(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, f"<p>{BODY * 3000}", "a"), (3, f"<p>{BODY}", "a")], "page_id long, html string, TEXT string")
    out = extract(rows)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r.page_id, r.n_chars) for r in out.collect()) == [(1, 0), (2, 0), (3, len(BODY)), (3, 3000 * len(BODY))]
    assert extract(rows.limit(0)).count() == 0


def archive(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    return warc.write(pages, folder, **options), warc.read(spark, folder)


ROWS = [(5, "http://a/x", "é" * 60), (2, "http://b/", "é" * 60), (9, None, "é" * 60), (3, "http://c/ q\n", "short"), (4, "http://d", "short"), (7, "http://e", None), (8, "http://f", ""), (2, "http://b/", "é" * 60)]


def test_archives_round_trip(spark, tmp_path):
    manifest, records = archive(spark, ROWS, tmp_path)
    got = sorted(((r.page_id, r.url, r.payload, r.record_type, r.refers_to) for r in records.collect()), key=str)
    want = [(2, "http://b/", "é" * 60, "response", None)] * 2 + [(3, "http://c/ q\n", "short", "response", None), (4, "http://d", "short", "response", None), (5, "http://a/x", None, "revisit", 2), (7, "http://e", "", "response", None), (8, "http://f", "", "response", None), (9, None, None, "revisit", 2)]
    assert got == sorted(want, key=str)
    for f in manifest.collect():
        data = (tmp_path / "w" / f.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f.bytes, f.sha256)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == f.records
    assert not list((tmp_path / "w" / "_temporary_warc").iterdir())


def test_archives_are_the_same_bytes_and_roll(spark, tmp_path):
    one = archive(spark, ROWS, tmp_path / "a", roll_bytes=1)[0].orderBy("file").collect()
    two = archive(spark, ROWS[::-1], tmp_path / "b", roll_bytes=1)[0].orderBy("file").collect()
    assert one == two and all(f.records == 1 for f in one)


def test_archives_are_in_order_and_even_on_any_cluster(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.choice(["http://hot/", f"http://h{i % 7}/{i}", None], p=[0.4, 0.5, 0.1]), "x" * int(rng.integers(0, 5000))) for i in rng.permutation(600)] + [(None, "http://h1/", "y" * 200), (2**62, "http://hot/", "z" * 200)]
    pages = spark.createDataFrame([(i, None if u is None else str(u), h) for i, u, h in rows], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    told = []
    try:
        for parts, shuffled in ((1, "2"), (7, "5")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            folder = f"file://{tmp_path}/{parts}"
            told.append(warc.write(pages.repartition(parts), folder, shard_bytes=100_000, roll_bytes=20_000).orderBy("file").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == told[1] and len({f.shard for f in told[0]}) > 10
    read = []
    for f in told[0]:
        with (tmp_path / "1" / f.file).open("rb") as stream:
            read += [(f.shard, *(lambda p: (p["url"], p["id"], p["bytes"]))(json.loads(warc.parse(data)[0]["X-Page"]))) for data in warc.members(stream)]
    order = [(u is None, u or "", i is None, i or 0) for _, u, i, _ in read]
    assert order == sorted(order) and len(order) == len(rows)
    sizes = [sum(n + 1024 for s, *_, n in read if s == shard) for shard in {s for s, *_ in read}]
    assert max(sizes) < 2 * np.median(sizes)


def test_damage_is_found(spark, tmp_path):
    data = warc.record(1, "http://a", "text", hashlib.sha256(b"text").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"text\r\n", b"tezt\r\n"))
    with pytest.raises(ValueError, match="digest"):
        warc.record(1, "http://a", "text", "0", None)


def test_no_pages(spark, tmp_path):
    manifest, records = archive(spark, [], tmp_path)
    assert manifest.count() == records.count() == 0


def judged(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in url_filter.judge(pages, **options).collect()}


def test_rules_of_urls(spark):
    urls = ["https://X.Example.COM/en/a?b#c", "http://www.example.com/en/", "http://a.com/", "http://a.com", "http://q.net/es/1", "http://net/fr/", "http://notnet/fr/", "no scheme", None, "http://h#f/x", "http://a.org/p?://x.com/"]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)])
    want = [("x.example.com", "/en/a", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.com", "/", "com/", "allow"), ("a.com", "", None, "allow"), ("q.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("notnet", "/fr/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("a.org", "/p", None, "allow")]
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == want


def test_rules_of_a_table(spark):
    """Rules beyond the expression's size give what the expression gives."""
    urls = ["https://X.Example.COM/en/a?b#c", "http://www.example.com/en/", "http://a.com/", "http://a.com", "http://q.net/es/1", "http://net/fr/", "http://notnet/fr/", "no scheme", None, "http://h#f/x", "http://a.org/p?://x.com/", "http://..com/", "http://a.com/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string")
    rules = (*url_filter.RULES, url_filter.Rule("", "/", True), url_filter.Rule("h", "", False))
    one, two = (sorted(url_filter.with_rule(pages, rules, most).select("page_id", "host", "path", "rule", "rule_allows", "html").collect()) for most in (500, 0))
    assert one == two and {r.rule for r in two} == {"example.com/en/", "www.example.com/en/", "com/", "net/es/", "net/fr/", "h", None}


def ranked(seeds, links, follow=0.85, rounds=200):
    """trust and distrust of each host, by plain loops."""
    hosts = set(seeds) | {h for e in links for h in e}
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    base = {h: tuple((1 - follow) * x for x in seeds.get(h, (0, 0))) for h in hosts}
    score = dict(base)
    for _ in range(rounds):
        new = {h: list(base[h]) for h in hosts}
        for (a, b), n in links.items():
            new[b][0] += follow * score[a][0] * n / out[a]
            new[a][1] += follow * score[b][1] * n / into[b]
        score = {h: tuple(v) for h, v in new.items()}
    return score


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f"<a class='x' href='https://{h}/p'>l</a>" for h in hosts)
    rows = [(1, "http://good.com/a", link("friend.org", "friend.org", "hub.org")), (2, "http://bad.net/es/x", link("victim.org")), (3, "http://farm.org/", link("bad.net", "bad.net")), (4, "http://friend.org/", link("hub.org")), (5, "http://hub.org/", "<a href='/own'>o</a><a href=//friend.org/z>z</a>"), (6, "http://victim.org/", None)]
    got = judged(spark, rows)
    links = {("good.com", "friend.org"): 2, ("good.com", "hub.org"): 1, ("bad.net", "victim.org"): 1, ("farm.org", "bad.net"): 2, ("friend.org", "hub.org"): 1, ("hub.org", "friend.org"): 1}
    want = ranked({"good.com": (1, 0), "bad.net": (0, 1)}, links)
    for r in got.values():
        assert (r.trust, r.distrust) == pytest.approx(want[r.host], abs=0.02)
    assert {r.host: r.verdict for r in got.values()} == {"good.com": "allow", "bad.net": "block", "farm.org": "block", "friend.org": "allow", "hub.org": "allow", "victim.org": "allow"}


def test_distrust_comes_from_any_distance(spark):
    chain = [(f"c{k}.org", f"c{k + 1}.org") for k in range(24)] + [("c24.org", "hub.org")]
    edges = chain + [("hub.org", f"bad{k}.net") for k in range(100)] + [("ring.org", "back.org"), ("back.org", "ring.org")]
    seeds = {f"bad{k}.net": (0.0, 1.0) for k in range(100)} | {"c0.org": (0.0, 0.0), "ring.org": (1.0, 0.0)}
    links = spark.createDataFrame([(*e, 1) for e in edges], "from_host string, to_host string, n long")
    scores = url_filter.propagate(spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), links)
    got = {r.host: (r.trust, r.distrust) for r in scores.collect()}
    want = ranked(seeds, dict.fromkeys(edges, 1))
    assert got.keys() == want.keys()
    for host, score in got.items():
        assert score == pytest.approx(want[host], abs=2e-6)
    assert got["c0.org"][1] == pytest.approx(100 * 0.15 * 0.85**26, abs=2e-6)


def test_url_edges(spark):
    assert judged(spark, []) == {}
    rows = spark.createDataFrame([(1, "http://a.com/", "x", "v"), (1, "http://a.com/", "x", "v")], "page_id long, url string, html string, verdict string")
    assert [r.verdict for r in url_filter.judge(rows).collect()] == ["allow"] * 2


def test_op5(spark):
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    got = entry.op5_url_filter(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        host = pages[r.page_id].split("://", 1)[1].split("/")[0].lower()
        fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert r.host == host and r.rule == (best.name if best else None)
        assert best is None or r.verdict == ("allow" if best.allow else "block")


def test_op4(spark):
    pages = table(spark, SF, "pages").collect()
    first = {}
    for p in pages:
        first[p.html] = min(first.get(p.html, p.page_id), p.page_id)
    for r in entry.op4_warc(spark, SF).collect():
        html = next(p.html for p in pages if p.page_id == r.page_id)
        again = len(html.encode()) >= 100 and first[html] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first[html] if again else None)
