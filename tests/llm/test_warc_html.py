import hashlib

from helixframe.llm import common, html_text, warc


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as digest", "1 as shard", "'y' as host", "2 as kind", "3 as n", "'z' as low")


def test_round_trip_with_revisits(spark):
    long = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://a/ b\n", long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "v", "short"), (8, "w", long + "x"), (9, "w", "\r\n\r\nWARC/1.1"), (9, "w", "\r\n\r\nWARC/1.1")]
    folder = common.scratch_path(spark, "warc")
    warc.write(pages(spark, rows), folder, shard_bytes=4000, file_bytes=600)
    found = {(r["page_id"], r["record_type"]): r for r in warc.read(spark, folder).collect()}
    assert warc.read(spark, folder).count() == len(rows)
    assert {k for k, r in found.items() if r["record_type"] == "revisit"} == {(1, "revisit"), (2, "revisit")} and found[1, "revisit"]["refers_to"] == 3
    for page_id, url, html in rows:
        raw = (html or "").encode()
        r = found.get((page_id, "response")) or found[page_id, "revisit"]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
        assert r["url"] == (None if url is None else url.replace(" ", "%20").replace("\n", "%0A"))
    assert spark.read.parquet(f"{folder}/manifest").count() > 1


def test_bytes_do_not_depend_on_the_layout(spark):
    rows = [(i * 7 % 101, f"http://h/{i}", "text " * (i % 50)) for i in range(101)]
    sums = []
    for parts in (1, 5):
        folder = common.scratch_path(spark, "warc")
        made = warc.write(pages(spark, rows).repartition(parts), folder, shard_bytes=5000, file_bytes=700)
        sums.append(sorted((r["path"], r["sha1"], r["records"]) for r in made.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_repeated_long_rows_and_empty_tables(spark):
    rows = [(4, "u", "y" * 2000)] * 3
    folder = common.scratch_path(spark, "warc")
    warc.write(pages(spark, rows), folder)
    kinds = sorted(r["record_type"] for r in warc.read(spark, folder).collect())
    assert kinds == ["response", "revisit", "revisit"]
    empty = common.scratch_path(spark, "warc")
    warc.write(pages(spark, rows).filter("page_id < 0"), empty)
    assert warc.read(spark, empty).count() == 0


ARTICLE = "<article><header><h1>Head &amp; line</h1></header><p>First\n  part <b>bold</b>, <a href='x'>link</a>.</p><p>Second<br>line</p><ul><li>One<li>Two</ul><div class='comments'><p>Nice!</p></div></article>"
PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body class=home><header>Site</header><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div><aside>More</aside>{}<form><input value=x>Search</form><div id='cookie-notice'>Cookies</div><footer>&copy; us</footer><script>var a = '</p>';</script></body></html>"


def test_article_without_its_surroundings():
    assert html_text.extract(PAGE.replace("{}", ARTICLE)) == "Head & line\n\nFirst part bold, link.\n\nSecond line\n\nOne\n\nTwo"
    assert html_text.extract(PAGE.replace("{}", "<main><p>Only</p></main>")) == "Only"
    assert html_text.extract(PAGE.replace("{}", "<div class='content-with-sidebar'><p>Body &#65;&nbsp;B</p></div>")) == "Body A B"
    assert html_text.extract("<p>open <b>never closed<p>next &lt;tag&gt;") == "open never closed\n\nnext <tag>"
    assert html_text.extract("no markup at all") == "no markup at all"
    assert html_text.extract("<body><article><p>cut off in the <b>mid") == "cut off in the mid"
    assert html_text.extract("") == html_text.extract(None) == ""


def test_branches_that_a_site_repeats_go(spark):
    page = "<html><body><div class='x1'><p>{}</p></div><div class='x2'><p>Always the same words</p></div></body></html>"
    rows = [(i, f"http://site/{i}", page.format(f"story number {i}")) for i in range(30)]
    rows += [(100, "http://other/", page.format("alone")), (101, None, None), (102, "http://e/", "")]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert found[3] == "story number 3"
    assert found[100] == "alone\n\nAlways the same words"
    assert found[101] == found[102] == ""
    again = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), broadcast_hosts=-1).collect()}
    assert again == found
    assert html_text.main_text(pages(spark, rows).filter("page_id < 0")).count() == 0


def test_repeated_branches_within_main_text_go(spark):
    page = "<html><body><main><h2>About {0}</h2><article><h1>Story {0}</h1><div class='x1'><p>told in words {0}</p></div><div class='x2'><p>Always the same words</p></div></article><p>Outside of it {0}</p></main><article><p>Further {0}</p></article></body></html>"
    copy = "<html><body><article><div class='x1'><p>The same story</p></div></article></body></html>"
    rows = [(i, f"http://site/{i}", page.format(i)) for i in range(30)] + [(i, f"http://copies/{i}", copy) for i in range(100, 140)] + [(200, "http://other/", page.format(1))]
    for most in (20_000, -1):
        found = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), broadcast_hosts=most).collect()}
        assert found[3] == "About 3\n\nStory 3\n\ntold in words 3\n\nOutside of it 3\n\nFurther 3"
        assert {found[i] for i in range(100, 140)} == {"The same story"}
        assert found[200] == "About 1\n\nStory 1\n\ntold in words 1\n\nAlways the same words\n\nOutside of it 1\n\nFurther 1"


def test_branches_on_few_pages_of_a_large_host_go(spark):
    page = "<html><body><div class='x1'><p>story number {}</p></div>{}</body></html>"
    rows = [(i, "http://site/", page.format(i, "<div class='section'><p>Menu of a section</p></div>" if i < 6 else "")) for i in range(400)]
    for most in ({"broadcast_hosts": 20_000}, {"broadcast_hosts": -1}, {"broadcast_nodes": 0}):
        found = html_text.main_text(pages(spark, rows), **most).collect()
        assert {r["page_id"]: r["text"] for r in found} == {i: f"story number {i}" for i in range(400)}


def test_tags_with_any_number_of_quoted_values():
    many = " ".join(f'a{i}="x > y{i}"' for i in range(1200))
    assert html_text.extract(f"<article><div {many}><p>The text.</p></div></article>") == "The text."
    assert html_text.extract("<article><p title='open>The text.</p></article>") == "The text."
    assert html_text.extract("<article>" + "<b title='>x</b> " * 3 + "</article>").endswith("x")
    html_text.tree("<a title='" * 100_000 + ">x")  # each quote is passed once
