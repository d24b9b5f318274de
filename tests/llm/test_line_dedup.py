from collections import Counter, defaultdict

from pyspark.sql import functions as F

from meibo.llm import line_dedup as L


def pages_of(spark, rows):
    """Pages with extra columns whose names clash."""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return pages.selectExpr("*", *[f"'x' as {c}" for c in "host lines key line salt places page n_pages".split()])


def brute(rows, ratio=L.MAX_RATIO, least=L.MIN_PAGES):
    """Rows are (page, host, lines)."""
    total, holding = Counter(), defaultdict(Counter)
    for _, host, lines in rows:
        total[host] += 1
        holding[host].update(set(lines))
    out = Counter()
    for page, host, lines in rows:
        kept = [x for x in lines if not (holding[host][x] >= least and holding[host][x] > ratio * total[host])]
        out[page, host, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def got(pages, **options):
    done = L.drop_site_lines_of_html(pages, **options)
    return Counter(map(tuple, done.select("page.page_id", "host", "n_lines", "n_dropped", "clean_text").collect()))


def test_matches_brute_force(spark):
    rows = []
    for i in range(40):
        lines = ["menu", f"own {i}", "menu", *(["half"] if i % 2 else []), *(["rare"] if i % 10 == 0 else []), f"own {i}", "foot"]
        rows.append((i, f"https://{'Hot' if i % 4 else 'small'}.example/{i}", lines))
    rows += [(100, "https://one.example/", ["menu", "foot"]), (101, None, ["menu"]), (1, rows[1][1], rows[1][2]), (None, None, [])]
    raw = [(p, u, "".join(f"<p>{x}</p>" for x in lines)) for p, u, lines in rows]
    want = brute([(p, (u or "").removeprefix("https://").split("/")[0].lower(), lines) for p, u, lines in rows])
    assert got(pages_of(spark, raw)) == want


def test_markup_becomes_lines(spark):
    html = "<title> A </title><script>var x='<p>';</script><STYLE>p{}</STYLE><!-- no <p> -->\r\n<p>one <b>two</b>\n three<br/>four<pre >five"
    text = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(L.text_lines(L.html_text(F.col("h")))).collect()
    assert [r[0] for r in text] == [["A", "one two", "three", "four", "five"], [], []]


def test_host(spark):
    urls = [("HTTP://A.Example:80/x",), ("https://b.example?q",), ("no url",), (None,)]
    hosts = spark.createDataFrame(urls, "u string").select(L.host_of(F.col("u"))).collect()
    assert [h[0] for h in hosts] == ["a.example", "b.example", "", ""]


def test_empty_table_and_long_page(spark):
    assert not got(pages_of(spark, []))
    long = "".join(f"<p>line {i % 5000}</p><p>again</p>" for i in range(20_000))
    rows = [(i, "http://h/", long) for i in range(4)]
    assert set(got(pages_of(spark, rows)).items()) == {((i, "h", 40_000, 40_000, ""), 1) for i in range(4)}


def test_carries_all_columns_but_the_page(spark):
    done = L.drop_site_lines_of_html(pages_of(spark, [(1, "http://h/", "<p>x")]))
    assert "html" not in done.select("page.*").columns and "salt" in done.select("page.*").columns


def test_no_python_in_the_plan(spark):
    plan = L.drop_site_lines_of_html(pages_of(spark, [(1, "http://h/", "<p>x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def lines_of(spark, *pages):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    return [r[1] for r in rows.select("i", L.text_lines(L.html_text(F.col("h")))).orderBy("i").collect()]


def test_unclosed_parts_hide_the_rest(spark):
    got = lines_of(spark, "a<script>b<p>c", "a<p>b<!-- c <p>d", "a<style x>b</style>c<style>d", "1 < 2<p>3 <b", "<scripty>x<p>y", "a <x y='<p>'> b")
    assert got == [["a"], ["a", "b"], ["a", "c"], ["1 < 2", "3 <b"], ["x", "y"], ["a  b"]]


def test_broken_pages_take_linear_time(spark):
    import time

    n = 1 << 20
    pages = ["<" * n, "<script>" * (n // 8), "<!--" * (n // 4), "<p " * (n // 3), " " * n + "x", "\t " * (n // 2) + "\n" + " " * n, "</script" * (n // 8)]
    start = time.time()
    got = lines_of(spark, *pages, "fine")
    assert time.time() - start < 20
    assert [len(x) for x in got] == [1, 0, 0, 1, 1, 0, 1, 1] and got[4] == ["x"]


def test_a_line_of_a_lone_page_stays(spark):
    rows = [(1, "http://a/", "<p>x<p>y"), (2, "http://b/1", "<p>x<p>y"), (3, "http://b/2", "<p>x<p>z")]
    assert got(pages_of(spark, rows)) == Counter({(1, "a", 2, 0, "x\ny"): 1, (2, "b", 2, 1, "y"): 1, (3, "b", 2, 1, "z"): 1})
