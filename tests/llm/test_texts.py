"""Language ID, PII, URL filter, HTML: small cases, brute force and edge cases."""

import re

import numpy as np
import pytest

from loomwright.llm import html_extract, language_id, pii, url_filter

SAMPLES = {
    "aa": "the quick brown fox jumps over the lazy dog and runs away from here ",
    "bb": "der schnelle braune fuchs springt ueber den faulen hund und rennt weg ",
    "cc": "el zorro marron salta sobre el perro perezoso y corre lejos de aqui ",
}


def test_language(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        lang = ("aa", "bb", "cc")[i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words, 30)), None if i % 10 == 0 else lang, "s"))
    rows += [(500, None, "aa", "s"), (501, "", None, "s"), (502, "123 !?", "bb", "s"), (503, SAMPLES["bb"] * 3000, None, "s"), (None, SAMPLES["cc"], None, "s"), (1, rows[1][1], rows[1][2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert sum(by[i]["lang_pred"] == ("aa", "bb", "cc")[i % 3] for i in range(150)) >= 148
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503]["lang_pred"] == "bb" and by[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(df).collect()] == ["und"]
    assert language_id.identify(df.limit(0)).collect() == []
    one = spark.createDataFrame([(i, "hello there", "xx") for i in range(6)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(one).collect()} == {"xx"}


def test_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(told) > 200 and sum(r["lang_pred"] == r["lang"] for r in told) >= 0.98 * len(told)


def test_every_language_is_learned_and_repeated_rows_change_nothing(spark):
    rng = np.random.default_rng(7)
    # 70 languages, each of ten words of its own; one of them holds most rows
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(10)] for _ in range(70)]
    rows = [(i, " ".join(rng.choice(words[i % 70], 12)), f"l{i % 70:02d}") for i in range(1400)]
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame(rows, schema), per_lang=15)
    assert len(model.langs) == 70
    shares = model.shares(np.array([language_id.features(" ".join(w)) for w in words]))
    assert (shares.argmax(axis=1) == np.arange(70)).mean() > 0.95
    again = language_id.train(spark.createDataFrame(rows + rows[:300] * 3, schema).repartition(5), per_lang=15 * 10**6, rows=10**9)
    once = language_id.train(spark.createDataFrame(rows, schema), per_lang=15 * 10**6, rows=10**9)
    assert np.array_equal(again.weights, once.weights)
    # a tie of shares gives the first language
    tied = language_id.Model(("aa", "bb"), np.ones((2, 1)), np.zeros((language_id.DIM, 1), np.float32), np.zeros(1, np.float32), np.ones(1), 6.0)
    got = language_id.predict(spark.createDataFrame([(1, "x", None)], schema), tied).first()
    assert (got["lang_pred"], got["score"], got["ambiguous"]) == ("aa", 0.5, True)


@pytest.mark.parametrize("k", [2, 4, 7, 12, 30])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= max(1, code.shape[1] // 4)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("a.@b-+ 0123456789()é%\n") + ["4111 1111 1111 1111", "a@b.c", "@", "10.0.0.1", "+1 (578) 555-6437", "256.1.1.1", "00000255.0.0.0001"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_digit_runs_are_quick():
    assert pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("a" * 200_000 + "@") == []


def test_pii(spark):
    texts = ["call +1 (578) 555-6437 4111111111111111 now", "mail jo.doe (at) example (dot) com please", "x@y.com", "10.0.0.1", None, "", "nothing 12 here", "order 9870157079875996 x", "+1 (578) 555-6437"]
    rows = [(i, t, "s") for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame([*rows, (None, "a@b.cd", "s")], "doc_id long, text string, spans string")
    model = pii.learn(df)
    got = {r["doc_id"]: r for r in pii.find(df, model, redacting=True).collect()}
    spans = lambda i: got[i]["spans"].split(",") if got[i]["spans"] else []
    assert "card:23:39" in spans(0) and got[0]["n_card"] == 0
    assert len(spans(1)) == 1 and spans(1)[0].startswith("email:5:")
    assert spans(2) == ["email:0:7"] and got[2]["redacted"] == "[EMAIL]"
    assert spans(3) == ["ip:0:8"] and spans(8) == ["phone:0:17"]
    assert spans(4) == spans(5) == spans(6) == spans(7) == [] and got[4]["redacted"] is None
    assert got[5]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[None]["n_email"] == 1
    assert pii.learn(df.limit(0)) is None and pii.find(df.limit(0), None).collect() == []


def planted(n: int, seed: int):
    """Texts with personal data, some lost to the base patterns, and decoys: (text, spans that are personal, spans that are not)."""
    import random

    rng = random.Random(seed)
    number = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))

    def card(good=True):
        while True:
            d = rng.choice(["4", "51", "55"]) + number(14)
            d += next(c for c in "0123456789" if pii.luhn(d + c)) if good else number(1)
            if len(d) >= 16 and pii.luhn(d[:16]) == good:
                return d[:16]

    email = lambda: f"{rng.choice(['jo', 'ann', 'kim'])}.{number(2)}@mail{number(1)}.example.com"
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{number(4)}"
    ip = lambda: ".".join(str(rng.randint(1, 223)) for _ in range(4))
    words = "the of and thing over under light said went still".split()
    for _ in range(n):
        yes, no, text = [], [], ""
        for _ in range(rng.randint(1, 4)):
            text += " ".join(rng.choices(words, k=rng.randint(3, 9))) + " "
            kind = rng.randint(0, 8)
            parts = {0: [email()], 1: [ip()], 2: [card()], 3: [phone()], 4: [card(), card()], 5: [phone(), card()]}.get(kind)
            if parts:
                for p in parts:
                    yes.append((text, p))
                    text += p + " "
            elif kind == 6:
                yes.append((text, p := f"jo{number(2)} (at) example (dot) com"))
                text += p + " "
            else:
                no.append((text, p := card(good=False) if kind == 7 else rng.choice([f"{ip()}.{number(2)}", f"{rng.randint(300, 999)}.{ip()[:5]}.7.8", "00" + number(11)])))
                text += p + " "
        spans = lambda some: {(len(before), len(before) + len(p)) for before, p in some}
        yield text + "end", spans(yes), spans(no)


def test_pii_finds_what_base_patterns_lose_and_refuses_decoys(spark):
    texts = list(planted(500, 3))
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    model = pii.learn(df)
    got = {r["doc_id"]: r["spans"] for r in pii.find(df, model).collect()}
    lost = caught = added = right = refused = decoys = 0
    for i, (text, yes, no) in enumerate(texts):
        base = {(a, b) for _, a, b in pii.base_spans(text)}
        every = {tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x}
        assert base <= every
        lost, caught = lost + len(yes - base), caught + len((yes - base) & every)
        added, right = added + len(every - base), right + len((every - base) & yes)
        decoys, refused = decoys + len(no - base), refused + len(no - base - every)
    assert lost > 100 and caught >= 0.9 * lost  # recall beyond the base patterns
    assert right >= 0.95 * added  # precision of what is added
    assert decoys > 100 and refused >= 0.95 * decoys
    assert all(min(model.population[k]) > 10 for k in ("card", "phone"))
    assert model.reliability["card", "structure"][0] > 0.9 and model.reliability["card", "structure"][1] > 0.8


def test_redaction_of_overlaps():
    assert pii.redact("abcdefghij", [("card", 2, 6), ("phone", 4, 8)]) == "ab[CARD]ij"


def test_urls(spark):
    def page(canonical=None, move=None):
        return "<html><head>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "") + (f'<meta http-equiv=refresh content="0; url={move}">' if move else "") + "</head></html>"

    rows = [
        (1, "https://a.example.net/es/x?q=1#f", None),
        (2, "http://WWW.Example.com/en/1", ""),
        (3, "https://sub.example.com/en", page()),
        (4, "https://sub.example.com/en/", page()),
        (5, "https://org.example.org/p", page(canonical="https://a.example.net/es/x")),
        (6, "https://other.org/z.html", page(move="/y")),
        (7, "https://other.org/y", page(canonical="HTTPS://Org.example.org/p")),
        (8, "https://fine.com/q", page(canonical="https://org.example.org/p")),
        (9, None, None),
        (10, "no scheme", page()),
        (11, "https://xcom/en/", page()),
        (12, "https://lone.org/en/", page()),
        (13, "http://foo.net/es", page()),
        (14, "http://foo.net/es/", page()),
        (15, "https://org.example.org/p/", "<!-- " + page(canonical="https://a.example.net/es/x") + " -->"),
        (16, "http://org.example.org/p", page()),
        (17, "https://www.org.example.org/p", page()),
        (1, "https://a.example.net/es/x?q=1#f", None),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    say = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert say(1) == ("a.example.net", "/es/x", "net/es/", "block")
    assert say(2) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert say(3) == ("sub.example.com", "/en", "com/", "allow")
    assert say(4) == ("sub.example.com", "/en/", "example.com/en/", "block")
    # aliases of a blocked URL, over several links, are blocked; an explicit allow stays
    assert [say(i)[2:] for i in (5, 6, 7)] == [(None, "block")] * 3
    assert say(8)[2:] == ("com/", "allow")
    assert say(9) == say(10) == ("", "", None, "allow")
    assert say(11)[2:] == say(12)[2:] == (None, "allow")
    # URLs that no edge joins are no aliases, however alike
    assert say(13)[2:] == (None, "allow") and say(14)[2:] == ("net/es/", "block")
    assert [say(i)[2:] for i in (15, 16, 17)] == [(None, "allow")] * 3
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_urls_against_union_find(spark):
    import random
    from urllib.parse import urldefrag, urljoin, urlsplit

    rng = random.Random(11)
    hosts, paths = ["a.net", "b.a.net", "c.org", "d.org", "x.com", "www.example.com"], ["/es/1", "/en/2", "/p", "/q/r", "/q/s?k=1", "/"]
    rules = [*url_filter.RULES, ("block", "a.net", "/q"), ("allow", "a.net", "/q"), ("block", "d.org", "/en/")]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths]
    rows, edges = [], []
    for i in range(160):
        url = rng.choice(urls) + rng.choice(["", "", "#part"])
        links = [rng.choice([rng.choice(urls), rng.choice(paths), rng.choice(paths).strip("/"), "#x"]) for _ in range(rng.choice([0, 0, 1, 2]))]
        tag = lambda t: rng.choice([f"<link href='{t}' rel='alternate canonical'>", f'<META HTTP-EQUIV="Refresh" content="0;URL={t}">'])
        rows.append((i, url, "x" * rng.choice([0, 200_000]) * (i % 40 == 0) + "".join(map(tag, links)), "block", "com"))
        edges += [(url, t) for t in links]
    rows += rows[:5]
    root = {}

    def find(u):
        while root.setdefault(u, u) != u:
            u = root[u]
        return u

    for url, t in edges:
        a, b = sorted((find(urldefrag(url)[0]), find(urldefrag(urljoin(url, t))[0])))
        root[b] = a

    def ruled(u):
        x = urlsplit(u)
        fit = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (x.netloc == h or x.netloc.endswith("." + h)) and x.path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    blocked = {find(u) for u in list(root) if ruled(u)[1] == "block"}
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        url = urldefrag(rows[r["page_id"]][1])[0]
        rule, verdict = ruled(url)
        assert (r["rule"], r["verdict"], r["component"]) == (rule, verdict or ("block" if find(url) in blocked else "allow"), find(url)), url
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple,\n text", "plain & simple, text"),
    ('<div class="comments"><p>a, b, c</p></div><div id=main><h2>T</h2><p>Hello &amp; w,\n x<br>y</p><p>second, with commas, yes</p></div><div class=sidebar><p>x, y, z</p></div>', "T\nHello & w, x y\nsecond, with commas, yes"),
    ('<nav><a href="/">menu</a></nav><article><header><h1>A</h1></header><p>text<script>bad("</p>")</script> more</p><div class="comment">c</div><aside>s</aside></article><footer>f</footer>', "A\ntext more"),
    ("<body><p>one<p>two<ul><li>x<li>y</ul></body>", "one\ntwo\nx\ny"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>kept<!-- open comment", "kept"),
    ("<article><p><b>bold<br><p>next</article>", "bold\nnext"),
    ("<article><p>a</p><form><p>f</p></form><p>tail &am", "a\ntail &am"),
    # quotes mean something only right behind an equals sign
    ("<article><p title=it's>one, and more</p><p>two, \"too\"</p></article>", 'one, and more\ntwo, "too"'),
    ("<article><p data-x=5\" '>one</p><p a='x > y' b=\">\">two</p></article>", "one\ntwo"),
    ("<article><p class = 'lead' id=x/>one<div/>two</article>", "one\ntwo"),
    ("<article><p>a<!--> b <!-- x --!> c</></p></article>", "a b c"),
    ("<article><p =a b= >one</p><p class=text class=advert>two</p></article>", "one\ntwo"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", p, 5) for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>", 5), (0, "u", "<p>" + "word, " * 60_000 + "</p>", 5)], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(df).collect()
    assert [(r["text"], r["n_chars"]) for r in got[: len(PAGES)]] == [(t, len(t)) for _, t in PAGES]
    assert (got[-2]["page_id"], got[-2]["text"]) == (None, "x") and got[-1]["n_chars"] == 6 * 60_000 - 1
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    # neither end tags without a start nor deep trees take quadratic time
    assert html_extract.main_text("<i>" * 30_000 + "deep" + "</b>" * 30_000) == "deep"


def test_pages_built_around_a_known_text(spark):
    import html
    import random

    rng = random.Random(23)
    words = "time, water people & place under <long> story it's \"house\" while above nation".split()
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    attrs = lambda: rng.choice(["", " title=it's", ' data-a="x > y"', " data-b='\"'", " lang=en'", " hidden-by=none"])
    rows, want = [], []
    for i in range(150):
        text = [sentence(rng.randint(12, 60)) for _ in range(rng.randint(2, 9))]
        body = ""
        for t in text:
            tag = rng.choice(["p", "p", "p", "blockquote", "h2"])
            shown = html.escape(t, quote=rng.random() < 0.5)
            shown = shown.replace("water", rng.choice(["<b>water</b>", "<a href=/w>water</a>", "water"]), 1)
            body += f"<{tag}{attrs()}>" + shown.replace(" ", rng.choice([" ", "\n  ", "\t"]), 3) + (f"</{tag}>" if tag != "p" or rng.random() < 0.6 else "")
            if rng.random() < 0.2:
                body += rng.choice([f"<script>if (a < b) {{ x = '<p>{sentence(9)}</p>' }}</script>", f"<aside>{sentence(20)}</aside>", f'<div class="ad banner">{sentence(20)}</div>', f"<!-- <p>{sentence(9)}</p> -->", f"<form><p>{sentence(9)}</p></form>"])
        main = rng.choice(['<article{}>{}</article>', '<div class="entry-content"{}>{}</div>', "<main{}>{}</main>"]).format(attrs(), body)
        menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>{sentence(2)}</a>" for k in range(8)) + "</ul></nav>"
        notes = f'<section id="comments"><p>{sentence(70)}</p><p>{sentence(40)}</p></section>'
        rows.append((i, "u", f"<!doctype html><html><head><title>t</title><style>p > a {{}}</style></head><body><header><h1>Site</h1></header>{menu}{main}{notes}<div class=sidebar><p>{sentence(30)}</p></div><footer>{sentence(12)}</footer></body></html>", "x"))
        want.append("\n".join(text))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r["text"] for r in got] == want and [r["n_chars"] for r in got] == list(map(len, want))


def test_relative_targets(spark):
    import string
    from urllib.parse import urljoin, urlsplit

    bases = ["https://www.A.org", "https://a.org/", "http://a.org/d/e/f.html?x=1", "https://m.a.org/d/e/"]
    targets = ["//b.net/es/x", "//B.net", "/", "/y", "/d/../z", "home.html", "./home.html", "../x", "../../../x", "g/./h/../i", "?q=1", "#top", "/to?u=http://c.net/es/p", "..", "http://c.net/es/p.html", "g;x=1/../y"]
    rows = [(b, t) for b in bases for t in targets]
    from pyspark.sql import functions as F

    said = spark.createDataFrame(rows, "b string, t string").select("b", "t", url_filter.resolved(F.col("b"), F.col("t")).alias("v")).collect()

    def form(u):
        x = urlsplit(u)
        return x._replace(netloc=x.netloc.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), fragment="").geturl()

    for r in said:
        assert r["v"] == form(urljoin(r["b"], r["t"])), r
    other = spark.createDataFrame([("mailto:x@b.net",), ("javascript:go()",), (None,)], "t string").select(url_filter.resolved(F.lit("http://a.org/"), F.col("t")))
    assert {r[0] for r in other.collect()} == {None}
    # urljoin drops empty steps, which the RFC keeps
    assert spark.range(1).select(url_filter.resolved(F.lit("http://a.org/d/e"), F.lit("a//b"))).first()[0] == "http://a.org/d/a//b"


def test_blocks_reach_relative_aliases(spark):
    link, move = '<link rel=canonical href="{}">', '<meta http-equiv=refresh content="0;url={}">'
    rows = [
        (1, "https://a.net/es/x", ""),
        (2, "https://one.org/p", link.format("//a.net/es/x")),
        (3, "https://one.org/q/r.html", move.format("../p")),
        (4, "https://one.org/q/home.html", link.format("r.html")),
        (5, "https://one.org/q/s", move.format("home.html")),
        (6, "https://one.org/q/home", link.format("r.html?x")),
        (7, "https://two.org/t", move.format("/")),
        (8, "https://two.org/", link.format("//one.org/q/s")),
        (9, "https://free.org/q/s", move.format("home.html")),
        (10, "https://free.org/u", link.format("/to?u=http://a.net/es/x")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # 6 names r.html with a query, which is another URL
    assert got == {i: "block" if i < 9 and i != 6 else "allow" for i in range(1, 11)}
