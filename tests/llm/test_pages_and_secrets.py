"""Page text, WARC captures, secrets and nearest neighbours on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
from conftest_llm import make_docs, prose
from pyspark.sql import functions as F

from plumbline.llm import learned_ann, secrets, site_templates, warc
from plumbline.llm.common import shared_folder


def test_page_text():
    cases = {
        '<p>foo <span class="ad">buy <b>x</b></span> bar</p>': "foo bar",
        '<div><p>A</p><div class="cookie-notice">x</div><ul><li>one<li>two</ul>t&amp;&nbsp;u</div>': "A\none\ntwo\nt& u",
        "": "",
        '<article><header><h1>T</h1></header>x<br>y<script>if(a<b){"</p>"}</script><article class="comment">no</article></article><footer>f': "T\nx y",
        "a<b c": "a<b c",
        "<article>k<p>a<p>b": "k\na\nb",
        "<title>t</title><body>x<!-- <p>no --><style>p{}</style></body>": "x",
        "<form>f</form><main><p>m</p><aside>s</aside></main><p>out</p>": "m",
        "<p>&lt;p&gt; &#233;&eacute;</p>": "<p> éé",
        "<svg/><p hidden>h</p><p role=alert>r</p>z": "z",
    }
    for html, text in cases.items():
        assert site_templates.Page(html).text() == text, html
    assert site_templates.Page(None).text() == "" and len(site_templates.Page("<p>" * 3000 + "x" * 200_000).text()) == 200_000


def test_site_templates(spark):
    template = "<div><div>Our house <b>style</b></div><p>Call us</p></div>"
    rows = [(n, f"http://a.example/{n}", f"<div><p>{prose(n, 20)}</p></div>{template}") for n in range(12)]
    # Copies of one page are no template of their site, nor is a block on few pages or on another host.
    rows += [(100 + n, f"http://b.example/{n}", f"<div><p>same page</p></div>{template}") for n in range(40)]
    rows += [(200, None, None), (201, "no url", ""), (202, "http://c.example", template), (0, rows[0][1], rows[0][2])]
    # A paragraph that many articles of a host quote stays.
    rows += [(300 + n, f"http://q.example/{n}", f"<article><p>{prose(n, 9)}</p><p>quoted by all</p><div>More on this site</div></article>") for n in range(12)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    out = site_templates.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[n] == prose(n, 20) for n in range(12))
    assert text[100] == text[139] == "same page\nOur house style\nCall us" and text[202] == "Our house style\nCall us"
    assert text[200] == text[201] == ""
    assert all(text[300 + n] == f"{prose(n, 9)}\nquoted by all" for n in range(12))
    assert all(r.n_chars == len(r.text) for r in got)
    assert site_templates.extract(pages.limit(0)).count() == 0


def test_text_outside_article(spark):
    """Counts per host decide on unmarked blocks beside an article, and on text beside elements."""
    rows = [
        (n, f"http://o.example/{n}", f"<body>House line<div>Our house</div><article><p>{prose(n, 5)}</p></article><div><p>{prose(n + 50, 9)}</p></div>loose {n}<div class='ad'>{n}</div>")
        for n in range(12)
    ]
    rows.append((20, "http://p.example", "<article><p>teaser</p></article><p>the story</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in site_templates.extract(pages).collect()}
    assert all(text[n] == f"{prose(n, 5)}\n{prose(n + 50, 9)}\nloose {n}" for n in range(12))
    assert text[20] == "teaser\nthe story"


def test_share_of_host(spark):
    """Rows and sentences that recur on a small share of a large host stay; few pages are enough for a template."""
    def html(n, again):
        return f"<article><p>{prose(n, 6)}</p>{again}</article>"

    table, menu = "<table><tr><td>Yes</td><td>No</td></tr></table>", "<div>House line</div>"
    rows = [(n, f"http://large.example/{n}", html(n, (table if n % 4 == 0 else "") + menu)) for n in range(120)]
    rows += [(200 + n, f"http://plain.example/{n}", f"<p>{prose(n, 6)}</p>" + ("<p>Yes.</p>" if n % 4 == 0 else "")) for n in range(120)]
    rows += [(400 + n, f"http://few.example/{n}", html(n, menu + ("<div>seen twice</div>" if n < 2 else ""))) for n in range(4)]
    rows += [(500 + n, f"http://two.example/{n}", html(n, menu)) for n in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in site_templates.extract(pages).collect()}
    for n in range(120):
        assert text[n] == prose(n, 6) + ("\nYes\nNo" if n % 4 == 0 else "")
        assert text[200 + n] == prose(n, 6) + ("\nYes." if n % 4 == 0 else "")
    assert all(text[400 + n] == prose(n, 6) + ("\nseen twice" if n < 2 else "") for n in range(4))
    assert all(text[500 + n] == f"{prose(n, 6)}\nHouse line" for n in range(2))


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_payload_is_hashed_once(spark):
    """The 32 letters of a digest share one hash in the plan."""
    texts = ["", "<p>a</p>", "ä" * 100]
    digests = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", warc.payload_digest(F.col("t")).alias("d"))
    want = {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts} | {None: None}
    assert {r["t"]: r["d"] for r in digests.collect()} == want
    assert digests._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1


def test_warc_round_trip(spark):
    htmls = ["<p>é one</p>", "", None, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny", "\r\n\r\n", "tail\r\n\r\n", "a" * 300_000, *["copy"] * 30]
    rows = [(n, f"http://h.example/{n}?q=1#f", h, "x") for n, h in enumerate(htmls)]
    rows += [(50, None, "no url", "x"), (51, "odd\r\nurl", "odd", "x"), (None, "http://h.example/n", "null id", "x"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = shared_folder(spark, "warc")
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_records(spark, path))
    largest = {}
    for n, _, h, _ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if n is None else n)
    expected = Counter()
    for n, _, h, _ in rows:
        first = n is None or largest[h or ""] == n
        expected[n, len((h or "").encode()), digest(h or ""), "response" if first else "revisit", None if first else largest[h or ""]] += 1
    assert Counter(tuple(r) for r in warc.page_digests(captures).collect()) == expected
    payloads = Counter(r.response.payload for r in captures.where("record_type = 'response'").collect())
    assert payloads == Counter((h or "") for n, _, h, _ in rows if n is None or largest[h or ""] == n)
    assert captures.where("request is null or metadata is null").count() == 0
    refers = captures.where("record_type = 'revisit'").selectExpr("response.refers_to as capture_id").distinct()
    assert refers.join(captures.where("record_type = 'response'"), "capture_id", "left_anti").count() == 0
    small = shared_folder(spark, "warc")
    warc.write_archives(pages, small, min_bytes=5)
    short = warc.page_digests(warc.assemble(warc.read_records(spark, small))).where("payload_bytes < 5")
    assert {r.record_type for r in short.collect()} == {"response"}
    none = shared_folder(spark, "warc")
    warc.write_archives(pages.limit(0), none)
    assert warc.page_digests(warc.assemble(warc.read_records(spark, none))).count() == 0


def plain_spans(text):
    """The base patterns as written, failing matches dropped afterwards."""
    assign = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


TEXTS = [
    None, "", "nothing", "password=abcdef", 'é🙂 TOKEN" : "abcdef123', "token=token:abcdef", "token=secret=abcdefg", "api_key=x api-key=abcdefgh apikey='abcdefgh'",
    "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 12, "AKIA" + "A" * 15, "f" * 24, "f" * 23, "token=" + "0f" * 20, "passwd : 12345 secret:123456",
    "tokentoken==abcdef", "Secret= ++++++ password:\nabcdef", "a" * 100_000 + " password=abcdef1 " + "g" * 1000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18,
]


def test_secrets(spark):
    docs = make_docs(spark, [*TEXTS, *["password=samesame"] * 40])
    docs = docs.unionByName(docs.where("doc_id = 3"))
    found = secrets.digests(secrets.scan(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        text = (TEXTS[r.doc_id] if r.doc_id < len(TEXTS) else "password=samesame") or ""
        spans = plain_spans(text)
        listed = ",".join("%s:%d:%d" % s for s in spans)
        counts = Counter(k for k, *_ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"]), text[:50]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in ("assign", "access", "hex")] == [s for s in listed.split(",") if s]
    assert secrets.scan(docs.limit(0)).count() == 0
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns
    assert clean[0].text is None and clean[2].text == "nothing" and clean[3].text == "[SECRET]" and clean[3].n_chars == 8
    assert clean[13].text == "[SECRET]" and clean[3].row == "x"
    for n, r in clean.items():
        assert not plain_spans((r.text or "").replace("[SECRET]", "|"))


def test_masked_keys(spark):
    """A private key is masked with its body: up to its END line, or as far as its lines go."""
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join(["MIIEow+/" * 8] * 30)
    cases = {
        f"a\n{head}\n{lines}\nQw==\n{end}\nb": "a\n[SECRET]\nb",
        f"k = '{head}\\n{'Ab+/' * 16}\\nQw==\\n{end}\\n'": "k = '[SECRET]\\n'",
        f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{lines}\n{end} b": "[SECRET] b",
        f"{head}\nDEK-Info: AES-128-CBC,0A1B\n\n{lines}\nQw==\nStory goes on.": "[SECRET]\nStory goes on.",
        f"{head} {'Ab' * 32} as prose goes on": "[SECRET] as prose goes on",
        f"{head}\r\n{lines}": "[SECRET]",
        f"{head}\nprose - and no key.": "[SECRET]\nprose - and no key.",
        f"{head} x {head}\n{lines}\n{end}": "[SECRET] x [SECRET]",
        head + "\n" + "Ab+/ \n" * 50_000 + end + "z": "[SECRET]z",
        (head + "\n") * 5_000 + "z": "[SECRET]\n" * 5_000 + "z",
        head + "\n" + (("Ab+/" * 16) + "\n") * 20_000 + "the end": "[SECRET]\nthe end",
    }
    got = {r.doc_id: r.text for r in secrets.redact(make_docs(spark, list(cases))).collect()}
    for n, (text, clean) in enumerate(cases.items()):
        assert got[n] == clean, (text[:80], got[n][:80])
    pem = next(r for r in secrets.MASK_RULES if r.kind == "pem")
    assert secrets.trigram_query(pem.pattern) == secrets.trigram_query(next(r for r in secrets.RULES if r.kind == "pem").pattern)


def test_trigram_queries():
    """Every match of a pattern holds the trigrams that its query asks for."""
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in filter(None, TEXTS):
            for match in re.finditer(rule.pattern, text):
                low = match[0].lower()
                assert any(all(t in low for t in need) for need in query)
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ANYTHING
    assert secrets.trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert secrets.trigram_query("(abc|abd)x?") == frozenset([frozenset(["abc"]), frozenset(["abd"])])
    assert secrets.trigram_query("(foo)+bar") == frozenset([frozenset(["foo", "bar"])])


def test_learned_ann(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 16))
    x = (centres[random.integers(0, 12, 3000)] + 0.4 * random.normal(size=(3000, 16))).astype(np.float32)
    x[500:1500] = x[500]
    rows = [(int(n), v.tolist(), 0) for n, v in enumerate(x)]
    rows += [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] * 16, 0), (9300, [1.0], 0), (9400, [None] * 16, 0), (None, [1.0] * 16, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    got: dict = {}
    for r in learned_ann.search(vectors, F.col("vec_id") % 100 == 0, parts=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    full, hit = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 3000, 100))
    for query, found in got.items():
        gap = np.sqrt(((full - full[query]) ** 2).sum(axis=1))
        gap[query] = np.inf
        best = np.argsort(gap, kind="stable")[:10]
        hit += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0]))
        np.testing.assert_allclose([s for _, s in found], gap[[v for v, _ in found]], rtol=1e-12)
    assert hit / (10 * len(got)) >= 0.9
    # All copies tie at 0; the smallest ids win.
    assert [v for v, _ in got[600]] == list(range(500, 510))
    assert learned_ann.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = learned_ann.search(vectors.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_balanced_parts():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(c, 0.3, (200, 4)) for c in (0, 5, 10, 15)])
    graph = learned_ann.neighbour_graph(x, 10)
    label = learned_ann.balanced_parts(x, graph, 4)
    sizes = np.bincount(label)
    assert sizes.max() - sizes.min() <= 2
    assert (label[graph] == label[:, None]).mean() > 0.9
