"""HTML extraction on hand-made sites, WARC round trips."""

import gzip
import hashlib
import os
import zlib

import brute  # noqa: F401
from callstrata.llm.op01_html import deduce, extract, main_text, op1_template_classes, parse
from callstrata.llm.op07_warc import archive_pages, inflated, normalise, op7_warc_members, read_back, write_monolithic
from callstrata.session import shared_dir
from conftest import SF

KIND = "page_id long, url string, html string, host string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], KIND)


def site(k, body, host="a.example"):
    return (k, f"http://{host}/{k}", f"""<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header>Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies {k}</div>
<div id="page"><div class="col">{body}</div><div class="sidebar">Latest {k}<p>more</p></div></div>
<form><label>Mail</label><input></form><section id="comments"><div class="comment"><p>Reader {k} says hi</p></div></section><footer>&copy; x</footer></body></html>""")


ARTICLE = "<article><h1>Title &amp; more {k}</h1><p>First&nbsp;paragraph   of\n page {k} <b>bold<br>x</b> &lt;tag&gt;<p>Second {k} é &#x1F600;<div class='ad'>Buy</div><ul><li>one {k}<li>two {k}</ul></article>"


def want(k):
    return f"Title & more {k}\nFirst paragraph of page {k} bold x <tag>\nSecond {k} é 😀\none {k}\ntwo {k}"


def test_article_is_extracted_without_its_surroundings(spark):
    rows = [site(k, ARTICLE.replace("{k}", str(k))) for k in range(8)] + [site(100, ARTICLE.replace("{k}", "100"), "single.example")]
    rows += [rows[3], (200, None, rows[0][2].replace("</body></html>", "")), (201, "http://a.example/n", None), (202, "nonsense", ""), (None, "http://a.example/x", "<p>lone <a>link")]
    got = {(r["page_id"], r["url"]): r for r in extract(pages(spark, rows)).collect()}
    assert extract(pages(spark, rows)).count() == len(rows)
    for k in [*range(8), 100]:
        r = next(x for (i, _), x in got.items() if i == k)
        assert r["text"] == want(k) and r["n_chars"] == len(want(k))
    assert got[200, None]["text"] == want(0)
    assert got[201, "http://a.example/n"]["text"] == got[202, "nonsense"]["text"] == "" and got[202, "nonsense"]["n_chars"] == 0
    assert got[None, "http://a.example/x"]["text"] == "lone link"


def test_template_text_goes_where_no_element_marks_the_article(spark):
    body = "<div class='text'><p>Share this story with friends</p><p>Real words of page {k} that only this page has, at some length indeed {k}.</p><p>Another line {k} goes on here.</p></div>"
    rows = [site(k, body.replace("{k}", str(k)), "b.example") for k in range(10)]
    for r in extract(pages(spark, rows)).collect():
        k = r["page_id"]
        assert r["text"] == f"Real words of page {k} that only this page has, at some length indeed {k}.\nAnother line {k} goes on here."


def test_no_block_is_lost_without_markers_or_around_them(spark):
    long = " ".join(f"word{j}" for j in range(60))
    blocks = ["Head", "Lead before", long, "Part two", "one", "two", "code", "cell", "Second section at some length"]
    body = f"<h1>Head</h1><p>Lead before<p>{long}</p><h2>Part two</h2><ul><li>one<li>two</ul><pre>code</pre><table><tr><td>cell</table><section><p>{blocks[-1]}</p></section>"
    inner = f"<main><p>Lead</p><article><p>{long}</p><article><p>Nested {long}</p></article><p>After</p></article><p>Tail</p></main>"
    shapes = {1: f"<html><body>{body}</body></html>", 2: f"<html><body><div>{body}</div></body></html>", 3: body, 4: f"<html><body><p>Aside text</p>{inner}</body></html>"}
    rows = [(k, f"http://host{k}.example/", h) for k, h in shapes.items()] + [(10 + k, f"http://many.example/{k}", shapes[4].replace("word0", f"w{k}")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert all(got[k].split("\n") == blocks for k in (1, 2, 3))
    assert got[4].split("\n") == ["Lead", long, "Nested " + long, "After", "Tail"]


def test_copies_and_shared_paragraphs_are_no_template(spark):
    shared = "<article><h1>News {k}</h1><p>The same long agency paragraph.</p><p>Own {k}</p></article>"
    rows = [site(k, shared.replace("{k}", str(k)) if k % 2 else ARTICLE.replace("{k}", str(k)), "c.example") for k in range(12)]
    rows += [(50 + k, "http://d.example/p", rows[1][2]) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got[1] == got[55] == "News 1\nThe same long agency paragraph.\nOwn 1"


def test_classes_nest_into_a_template():
    t = lambda token, pages, vector, path, plain: {"token": token, "pages": pages, "vector": vector, "path": path, "plain": plain}
    got = deduce([t(1, 10, 7, "html", 90), t(2, 10, 7, "html/body", 90), t(3, 9, 5, "html/body/main", 80), t(4, 9, 5, None, 0), t(5, 8, 3, None, 0)], 10)
    assert got["region"] == "html/body/main" and got["furniture"] == [4]
    assert got["classes"] == [" > html (2 tokens, 10 pages)", "html > html/body/main (2 tokens, 9 pages)"]


def test_parser_takes_any_input():
    for bad in ("<", "<<<>>>", "<a href='x", "</p></div>", "<!-- open", "<p " + "x='" * 50, "<script>never closed", "a < b && c > d", "<p>" * 2000):
        main_text(bad, None, frozenset())
    assert main_text("a < b &amp; c", None, frozenset()) == "a < b & c"
    assert [b.text for b in parse("<table><tr><td>a<td>b<tr><td>c</table>d").blocks] == ["a", "b", "c", "d"]
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert main_text(long, None, frozenset()).count("word") == 20_000


def test_extraction_on_the_table_and_on_nothing(spark):
    import html
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op1_template_classes(spark, SF).collect():
        inside = rows[r["page_id"]].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"].replace(" ", "") == "\n".join(b for b in blocks if b).replace(" ", "")
    assert extract(pages(spark, [])).count() == 0


BODY = "<p>" + "same payload " * 20 + "</p>"
WARC = [(5, "http://x/5", BODY), (2, "http://x/2", BODY), (9, None, BODY), (1, "u\r\nX: y é", "short"), (3, "http://x/3", "short"), (4, "http://x/4", None), (6, "http://x/6", ""), (6, "http://x/6", ""),
        (7, "http://x/7", "é😀\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 30), (None, "http://x/n", BODY), (2, "http://x/2", BODY), (8, "http://x/8", "long " * 200_000)]


def test_archives_are_rewritten_by_record(spark):
    folder = shared_dir(spark, "warc-test")
    index = archive_pages(pages(spark, WARC).repartition(3), folder)
    got = read_back(index).collect()
    size = lambda h: len((h or "").encode())
    want = []
    for i, _, h in WARC:
        first = min((j for j, _, g in WARC if j is not None and (g or "") == (h or "")), default=None)
        again = size(h) >= 100 and i is not None and first != i
        want.append((str(i), size(h), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", str(first) if again else "None"))
    assert sorted((str(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers"])) for r in got) == sorted(want)
    for path in {r["archive"] for r in index.collect()}:
        raw = open(path.removeprefix("file://"), "rb").read()
        rows = sorted((r["position"], r["length"], r["seq"]) for r in index.filter(index.archive == path).collect())
        lines = open(path.removeprefix("file://") + ".idx").read().splitlines()
        assert [tuple(map(int, x.split()[:2])) for x in lines] == [r[:2] for r in rows]
        assert sum(r[1] for r in rows) == len(raw) and [r[0] for r in rows] == [sum(x[1] for x in rows[:k]) for k in range(len(rows))]
        parts = [zlib.decompress(raw[a:a + n], 31) for a, n, _ in rows]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts) and b"".join(parts) == gzip.decompress(raw)


def test_a_whole_file_stream_is_read_once_and_in_order(spark, tmp_path):
    rows = write_monolithic(pages(spark, WARC).coalesce(1), f"file://{tmp_path}/in").collect()
    path = rows[0]["archive"]
    raw = open(path.removeprefix("file://"), "rb").read()
    stream = zlib.decompressobj(31)
    whole = stream.decompress(raw)
    assert stream.eof and not stream.unused_data and whole.count(b"WARC-Type: response") == len(WARC)
    assert [b[b.index(b"\r\n\r\n") + 4:].decode() for _, b in inflated(path)] == [h or "" for _, _, h in WARC]
    two = tmp_path / "two.warc.gz"
    two.write_bytes(raw + raw)
    assert sum(1 for _ in inflated(str(two))) == 2 * len(WARC)
    cut = spark.createDataFrame([(str(two), None)], "archive string, again array<struct<seq:int,first:string>>")
    assert normalise(cut).count() == 2 * len(WARC)
    assert len(os.listdir(tmp_path)) >= 4


def test_warc_on_the_table_and_on_nothing(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op7_warc_members(spark, SF).collect()
    assert len(got) == len(rows) and all(r["payload_bytes"] == len(rows[r["page_id"]].encode()) for r in got)
    assert read_back(archive_pages(pages(spark, []), shared_dir(spark, "warc-test"))).count() == 0
