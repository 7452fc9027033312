"""HTML, secrets, quality and the pipeline."""

import hashlib
import random
import re
import string
import time

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import html_text, quality, secret_scan
from tests.llm.conftest import documents

HEX = "0123456789abcdef" * 3


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("a <b> b </b> c", "a b c"),
        ("<ul><li>a<li>b<ol start=2><li>x<li>y</ol></ul>", "- a\n- b\n  2. x\n  3. y"),
        ("<table><tr><th>n<th>v<tr><td>long<td>1<tr><td>s<td>22</table>after", "n     v\nlong  1\ns     22\n\nafter"),
        ("<head><title>t</title><style>x</style></head><body>y<script>if (a</p>b) {}</script>z", "yz"),
        ("<div style='color:red; DISPLAY : none'>no<p>no</div>yes<p hidden>no</p>", "yes"), ("<template>no</template><noscript>no</noscript>y", "y"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("<textarea>kept &lt; <b></textarea>", "kept < <b>"), ("a<!-- <p>no -->b", "ab"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("</div></p>x</br>y", "x\ny"), ("<dl><dt>k<dd>v</dl>", "k\n    v"), ("<blockquote>q<br>r</blockquote>", "> q\n> r"), ("<a href='>'>l</a>", "l"),
        ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in  b"), ("<head>early text<p>x", "early text\n\nx"), ("<script>never closed", ""),
    ],
)
def test_render(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tr><td>a</td></tr><p>rest of the page", "rest of the page\n\na"), ("<div><table><tr><td>a</td></tr></div><p>rest", "rest\n\na"),
        ("<table><div>note</div><tr><td>a<td>b</table>after", "note\n\na  b\n\nafter"), ("x<table>\n<tr>y\n<td>a</table>", "xy\n\na"),
        ("<table><caption>c</caption><tr><td>a</td></tr>stray</table>", "stray\n\nc\na"),
        ("a<svg><title>t</title><defs><text>no</text></defs><path d='m'/><text x='1'>one</text><text>two</text></svg>b", "a\none\ntwo\nb"),
        ("<svg><style/><defs/><text>x</text></svg>", "x"), ("<svg><defs><p>y", "y"), ("<svg/>z", "z"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("Size: <select><option>S<option selected>M<option>L</select>.", "Size: M ."), ("<select><option disabled>no<option>first<option>no</select>", "first"),
        ("<select multiple><optgroup label=g><option>a<option label=b>x</select>", "g\na\nb"), ("<select><option>a<input value=v>", "a v"),
    ],
)
def test_stray_text_and_foreign_elements(html, text):
    assert html_text.render(html) == text


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert html_text.render("<ul><li>" * 300 + "x").endswith("- x")
    assert len(html_text.render("<p>word" * 50_000).split("\n\n")) == 50_000


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
        ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r  x\n   y"), ("<table><tr><td rowspan=0>r<td>x<tr><td>y<tr><td>z</table>", "r  x\n   y\n   z"),
        ("<table><tr><td rowspan=2>1<br>2<br>3<td>x<tr><td>y</table>", "1  x\n2  y\n3"), ("<table><tr><td>a<td><td>b<tr><td>c<td>d<td>e</table>", "a     b\nc  d  e"),
        ("<table><tr><td>a<td rowspan=2>b<tr><td colspan=2>over<td>c</table>", "a  b\nover  c"),
        ("<table><tr><td>a<br>b<td><pre>c\n d</pre><tr><td>日本<td>e</table>", "a     c\nb      d\n日本  e"),
        ("<table><tr><td><table><tr><td>in<tr><td>two</table><td>b</table>", "in   b\ntwo"),
        ("a<dialog>no</dialog><dialog open>yes</dialog>", "a\nyes"), ("<details>no<summary>s</summary>no<p>no<summary>no</summary></details>y", "s\ny"),
        ("<details open><summary>s</summary>yes<details><p>no</details></details>", "s\nyes"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<hr></div>z", "yes\nz"),
        ("<p style='display:none'>no<b style='visibility:visible'>no</b></p><p hidden style='display:block'>y", "y"),
        ("<ol reversed><li>a<li hidden>no<li>b<ol reversed start=9><li>c</ol><li>d</ol>", "3. a\n2. b\n  9. c\n1. d"), ("<ol><li value=5>a<li>b<li value=x>c</ol>", "5. a\n6. b\n7. c"),
    ],
)
def test_spans_and_visibility(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + "x", "<blockquote><p>x" * 20_000, "<ul><li>x" * 20_000, "<table><tr><td>x" * 20_000, "<details open><p>x" * 20_000,
        "<table><tr><td>" + "x " * 200_000 + "<td>x" + "<tr><td>x<td>x" * 10_000, "<table><tr>" + "<td rowspan=65534>x" * 5_000 + "<tr><td colspan=1000>x" * 5_000,
        "<table><tr>" + ("<td>" + "x" * 80) * 1000 + "<tr>" + "<td>x" * 999 + "<td>" + "x<br>" * 10_000, "<a><div>x" * 30_000 + "</i></a>" * 30_000,
    ],
)
def test_work_and_output_are_bounded_by_the_page(page):
    begun = time.process_time()
    text = html_text.render(page)
    assert time.process_time() - begun < 20 and len(text) < 40 * len(page)
    assert text.count("x") == page.count("x")


def random_page(draw, depth=0):
    """A page of blocks, its end tags left out where they may be, and the words that are seen, in order."""
    html, words = "", []
    for _ in range(draw.randint(1, 4)):
        kind = draw.choice(["word", "p", "div", "ul", "hidden", "veil", "details", "b", "blockquote", "comment"] if depth < 5 else ["word"])
        if kind == "word":
            word = f"w{draw.randrange(10**6)}"
            html, words = html + f" {word} ", [*words, word]
            continue
        inner, seen = random_page(draw, depth + 1)
        if kind == "p":
            word = f"p{draw.randrange(10**6)}"
            html, words = html + f"<p>{word}" + draw.choice(["</p>", "<div></div>"]), [*words, word]
        elif kind == "ul":
            html += "<ul>" + f"<li>{inner}" * 2 + draw.choice(["</li>", ""]) + "</ul>"
            words += seen * 2
        elif kind == "details":
            html += f"<details><summary>sum</summary>{inner}</details>"
            words.append("sum")
        elif kind == "comment":
            html += f"<!-- {inner} -->" if "--" not in inner else ""
        elif kind in ("hidden", "veil"):
            html += f"<div {'hidden' if kind == 'hidden' else 'style=visibility:hidden'}>{inner}</div>"
        else:
            html, words = html + f"<{kind}>{inner}</{kind}>", words + seen
    return html, words


def test_random_pages_show_what_is_seen():
    draw = random.Random(7)
    for _ in range(300):
        html, words = random_page(draw)
        assert re.findall(r"[a-z]\w+", html_text.render(html)) == words, html


def test_random_tables_are_aligned():
    draw = random.Random(8)
    for _ in range(100):
        columns = draw.randint(1, 6)
        rows = [["".join(draw.choices("abc日", k=draw.randint(1, 9))) for _ in range(columns)] for _ in range(draw.randint(1, 8))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
        places = [len(c) + c.count("日") for r in rows for c in r]
        widths = [max(places[i::columns]) for i in range(columns)]
        plain = ["  ".join(c + " " * (w - len(c) - c.count("日")) for c, w in zip(r, widths)).rstrip() for r in rows]
        assert html_text.render(html).split("\n") == plain


def test_extract(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", ""), (3, "u", "<<<>>&#x110000;<")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages).collect()]
    assert got[:4] == [(1, "a"), (1, "a"), (2, ""), (None, "")] and len(got) == 5
    assert html_text.extract(pages.limit(0)).collect() == []


def plain_spans(text):
    """The base kinds as their patterns say, without any sieve."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (kind, pattern, least) in enumerate((("assign", assign, 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(found))


SECRETS = [
    None, "", "clean words only", f"token = \"{HEX}\" é {HEX}", "ÄPI_KEY:'abc123' API_KEY = abcde apikey=abcdef", "secret:token:abcdef", "AKIA" + "A" * 16,
    "AKIA" + "B" * 15, "toKen = abcdefgh", "paſſword=abcdefgh", "PASSWORD  :  x.y-z/1=2 passwd='short'", "x" * 400_000 + f" token={HEX}",
]


def test_base_spans(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(SECRETS)], ("spans", "kind"))
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    for i, text in enumerate(SECRETS):
        expected = plain_spans(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        base = [s for s in rows[i]["spans"].split(",") if s and not s.startswith("novel")]
        assert ",".join(base) == expected
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [expected.count(f"{k}:") for k in ("assign", "access", "hex")]
    assert secret_scan.scan(docs.limit(0)).collect() == []


def test_novel_strings(spark):
    random, value = "Zk3vQ9x1PbT7mW2sLr8YdE5u", "the key the_name_of_the_connection is long"
    texts = [f"the private key is {random} here", value, f"no context {random}", f"key {random} key {random}x", "auth " + "ab" * 20]
    rows = {r["doc_id"]: r for r in secret_scan.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert rows[0]["spans"] == "novel:19:43" and rows[0]["n_novel"] == 1
    assert all(rows[i]["n_novel"] == 0 for i in (1, 2, 3, 4))  # a string that the text repeats is no news


def test_novel_strings_after_identifiers():
    secret = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ83vTq5LsHd"
    meter = secret_scan.Meter(secret_scan.Novelty())
    for before in (
        "aws_secret_access_key = ", "SECRET_KEY = '", "private_key: ", "accessKey=", "auth_header = ", "x-auth-header: ", "sshkey ", "?user=x&accessKeyId=",
        "key the_name_of_the_connection_of_this_session=",
    ):
        text = f"some words {before}{secret}' and more"
        assert [(a, b) for _, a, b in secret_scan.novel_spans(text, [], meter)][-1:] == [(text.index(secret), text.index(secret) + len(secret))], before
        assert re.search(secret_scan.NOVEL_SIEVE, text)


def test_novel_strings_on_the_next_line():
    secret = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ83vTq5LsHd"
    meter = secret_scan.Meter(secret_scan.Novelty())
    for before in ("private_key:\n  ", 'auth: {\n  "value": "', "SECRET = \\\n", "token: |\n\t", "credentials: [\r\n '"):
        text = f"some words {before}{secret}' and more"
        found = [text[a:b] for _, a, b in secret_scan.novel_spans(text, [], meter)]
        assert found == ([] if "\\" in before else [secret]), before
    assert not secret_scan.novel_spans(f"a sentence on the key\n{secret} here", [], meter)


def test_long_candidates_are_held_by_the_same_rule():
    draw, meter = random.Random(4), secret_scan.Meter(secret_scan.Novelty())
    for length in (250, 257, 300, 4000, 5000, 100_000):
        value = "".join(draw.choices(string.ascii_letters + string.digits, k=length))
        text = f"the key is {value} here"
        assert [text[a:b] for _, a, b in secret_scan.novel_spans(text, [], meter)] == [value]
        words = "_".join(draw.choices(["name", "connection", "default", "value", "of", "the", "list"], k=length // 6))
        assert not secret_scan.novel_spans(f"the key is {words} here", [], meter), length


def test_novel_strings_among_others_of_their_kind():
    draw, meter = random.Random(3), secret_scan.Meter(secret_scan.Novelty())
    prose = "Most of the members came by train, and some of them stayed until the end of the week. " * 3
    base62, base36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    for alphabet, length, least in ((base62, 16, 0.9), (base62, 20, 0.9), (base62, 32, 1), (base62, 64, 1), (base36, 20, 0.9), (base36, 32, 0.95)):
        values = ["".join(draw.choices(alphabet, k=length)) for _ in range(120)]
        found = 0
        for i in range(0, 120, 12):  # lists of twelve keys
            text = prose + "".join(f"key {v}\n" for v in values[i : i + 12]) + prose
            found += len(secret_scan.novel_spans(text, [], meter))
        alone = sum(len(secret_scan.novel_spans(f"{prose} the key is {v} {prose}", [], meter)) for v in values)
        assert min(found, alone) >= least * 120, (len(alphabet), length, found, alone)
    lines = "".join("".join(draw.choices(base62 + "+/", k=76)) + "\n" for _ in range(40))
    text = lines + "key = " + (value := "".join(draw.choices(base62, k=40))) + "\n" + lines
    assert [text[a:b] for _, a, b in secret_scan.novel_spans(text, [], meter)] == [value]


def test_names_and_words_are_no_news():
    meter = secret_scan.Meter(secret_scan.Novelty())
    prose = "Most of the members came by train, and some of them stayed until the end of the week. " * 3
    for name in ("getUserPrivateKeyFromStore", "the_name_of_the_connection", "responsibilities-of-members", "usr/local/share/applications", "default_connection_name"):
        assert not secret_scan.novel_spans(f"{prose} the key is {name} {prose}", [], meter), name


def test_redact(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(SECRETS)], ("kind",))
    got = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert got[2]["text"] == SECRETS[2] and got[0]["text"] is None
    assert got[3]["text"] == '<secret>" é <secret>' and got[3]["n_chars"] == len(got[3]["text"])
    assert secret_scan.redact(docs).schema == docs.schema and len(got) == len(SECRETS)
    assert secret_scan.redact(docs.limit(0)).collect() == []


def good_and_bad():
    random = np.random.default_rng(12)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}###" for i in range(60)]
    rows = [(i, " ".join(random.choice(bad if i % 5 == 0 else good, 60)), "s") for i in range(500)]
    return rows, [(i,) for i, _, _ in rows if i % 5 and i % 2]


def test_resampling_against_plain_counts(spark):
    rows, ids = good_and_bad()
    docs, target = documents(spark, rows, CLASH := ("kept", "n_words")), spark.createDataFrame(ids, "doc_id long")
    got = {r["doc_id"]: r for r in quality.resample(docs, target).collect()}
    assert len(got) == 500 and len(CLASH) == 2
    kept = {i for i, r in got.items() if r["kept"]}
    assert len(kept) == 400 and kept == {i for i in range(500) if i % 5}
    keys = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r["gumbel_key"] >= keys[399]} == kept
    counts = np.zeros((2, 64))
    import pyarrow as pa

    rule, wanted = quality.Resampling(buckets=64), {i for i, in ids}
    for i, text, _ in rows:
        grams, _ = quality._grams(pa.array([text]), 64)
        for bucket in grams.ravel():
            counts[0, bucket] += 1
            counts[1, bucket] += i in wanted
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    assert np.allclose(quality.ratios(docs, target, rule), np.log(share[1] / share[0]))


def test_gumbel_draws_in_proportion(spark):
    noise = [r[0] for r in spark.range(20_000).select(quality.gumbel("id", 3)).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.03 and abs(np.var(noise) - np.pi**2 / 6) < 0.06


def test_largest(spark):
    values = [float(v) for v in [*range(300), 7, 7, 7, -1e9, 1e12]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 150, 297, 305):
        assert quality.largest(df, "v", k, bins=4) == sorted(values, reverse=True)[k - 1]
    assert quality.largest(df.limit(0), "v", 5) == float("inf")


def test_quality_odd_and_empty(spark, odd):
    target = spark.createDataFrame([(4,), (None,), (4,)], "doc_id long")
    rows = quality.resample(odd, target).collect()
    assert len(rows) == 10 and {r["log_weight"] for r in rows if r["n_words"] == 0} == {0.0}
    assert quality.resample(odd.limit(0), target.limit(0)).collect() == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
        if name != "mix":
            assert kept.count() <= before.count()
    assert kept.select("doc_id").distinct().count() > 0.5 * docs.count()
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert result.count() == kept.count()


def test_near_duplicates_of_the_pipeline_begin_at_four_fifths(spark, sf_dir):
    rows = []
    for i in range(20):  # four of 200 words changed: similarity 176 / 216 = 0.81; six: 166 / 226 = 0.73
        words = [f"w{i}x{j}" for j in range(200)]
        four, six = ([f"other{j}" if j in range(20, 20 + 25 * n, 25) else w for j, w in enumerate(words)] for n in (4, 6))
        rows += [(3 * i, " ".join(words), "s"), (3 * i + 1, " ".join(four), "s")] if i % 2 else [(3 * i, " ".join(words), "s"), (3 * i + 2, " ".join(six), "s")]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in rows if i % 3 != 1}


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    for rows in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
        rows.collect()
