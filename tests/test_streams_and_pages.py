"""Streams with state, crawls of many searches, and pages of any shape."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfline.functions.text import asked, relevance_between, with_relevance
from shelfline.operators.ranking import with_rank
from shelfline.plans.pipeline import candidates
from shelfline.plans.storage import shared_dir, stored
from shelfline.sources import sites
from shelfline.sources.connector import ShopPages, read_products
from shelfline.sources.dom import parse
from shelfline.sources.nodes import Pick, Spec
from shelfline.streaming import frontier, settle
from shelfline.streaming.incremental import rank_batches, settle_times
from shelfline.streaming.state import RankState

from .test_operators import CARD, html_pages, product, table

START = datetime(2024, 1, 1)


def plain_runs(events, quiet, cap):
    """started -> (settled, grown), one trigger after another."""
    events = sorted(set(events), key=lambda e: (e[0], not e[1]))
    out = {}
    for k, (at, trigger) in enumerate(events):
        if trigger:
            last, grown = None, 0
            for t, again in events[k + 1 :]:
                if again or t > at + cap or (last is not None and t > last + quiet):
                    break
                last, grown = t, grown + 1
            out[at] = (min(at + cap, at + cap if last is None else last + quiet), grown)
    return out


def test_runs_close_once_the_watermark_passes():
    rnd = random.Random(7)
    for _ in range(300):
        times = rnd.sample(range(200), 30)
        events = [(t, rnd.random() < 0.3) for t in times]
        late = sorted(events, key=lambda e: e[0] + rnd.randrange(25))
        got, state, passed = {}, [], -1
        for k, e in enumerate(late):
            state.append(e)
            passed = max(passed, max(t for t, _ in late[: k + 1]) - 26)
            done, state = settle.closed_runs(state, 9, 40, passed)
            for start, settled, grown in done:
                assert start not in got
                got[start] = (settled, grown)
        done, state = settle.closed_runs(state, 9, 40, 10**6)
        got.update({start: (settled, grown) for start, settled, grown in done})
        assert not state and got == plain_runs(events, 9, 40)


def test_settle_on_a_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 3, None]), START + timedelta(minutes=m), rnd.choice(["view", "click", None])) for m in rnd.sample(range(2000), 160)] + [(1, None, "view")]
    events = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, kind string")
    key = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000, F.lit(0.0)) + F.pmod(F.xxhash64("ts"), F.lit(90))
    ordered = events.orderBy(key).collect()
    batches = [spark.createDataFrame(ordered[i : i + 60], events.schema) for i in range(0, len(ordered), 60)]
    got = settle.settle_batches(spark, batches, str(tmp_path / "s"), "user_id", "ts", F.col("kind") == "view", "30 MINUTES", "3 HOURS", "2 HOURS")
    want = settle_times(events.where("ts IS NOT NULL").withColumn("kind", F.coalesce("kind", F.lit(""))), "user_id", "ts", F.col("kind") == "view", "30 MINUTES", "3 HOURS")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20


def arrivals(seed, n=90):
    rnd = random.Random(seed)
    return [
        product(k, title=rnd.choice(["red widget", "blue widget case", "Untitled", "widget"]), price=rnd.choice([None, 0.0, 5.0, 500.0]), review_count=float(rnd.randrange(9)) or None, asin=rnd.choice([None, "B000000001", "B000000002", "B000000003"]),
                canonical_url=rnd.choice([None, "https://www.amazon.in/dp/X", ""]), is_sponsored=rnd.random() < 0.3, sponsored=False, url=f"https://shop.example/p/{k}")
        for k in range(n)
    ]


def shown(df):
    return sorted((r["rank"], r["ordinal"], r["title"], r["price"]) for r in df.collect())


def test_state_equals_all_rows(spark, monkeypatch):
    monkeypatch.setattr("shelfline.streaming.state.COMPACT", 2)
    rows = arrivals(1)
    random.Random(2).shuffle(rows)  # ordinals may come late
    state, options = RankState(spark, shared_dir(spark, "state"), "red widget", 1.0, None), ("red widget", 1.0, None)
    for k in range(4):
        part = rows[k * 20 : k * 20 + 20] if k != 2 else []
        state.merge(table(spark, part), k)
        if k % 2:
            state.merge(table(spark, part), k)  # tried again
        so_far = [r for j in range(k + 1) if j != 2 for r in rows[j * 20 : j * 20 + 20]]
        assert shown(state.ranked(k)) == shown(with_rank(candidates(table(spark, so_far), *options)))
    assert shown(RankState(spark, state.folder, *options).ranked(3)) == shown(state.ranked(3))


def test_rankings_of_a_stream_stay_where_nothing_can_be_ranked(spark):
    rows = arrivals(5, 40)
    none = [product(1000 + k, title="Untitled") for k in range(3)]
    got = rank_batches(spark, [table(spark, none), table(spark, rows), table(spark, none)])
    assert got[0].isEmpty() and shown(got[1]) == shown(got[2]) == shown(with_rank(candidates(table(spark, rows))))


def test_a_batch_of_a_stream_is_written_as_often_as_it_must(spark, monkeypatch):
    """Keys of the batch, changed keys, rows to rank and their places; the
    ranking itself once, in its folder."""
    written = []

    def counted(df, name, *rest):
        written.append(name)
        return stored(df, name, *rest)

    for module in ("streaming.incremental", "streaming.state", "operators.ranking"):
        monkeypatch.setattr(f"shelfline.{module}.stored", counted)
    state = RankState(spark, shared_dir(spark, "state"))
    changes = state._changes(state._fresh(table(spark, arrivals(6, 20))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in changes
    written.clear()
    got = rank_batches(spark, [table(spark, arrivals(5, 40))])
    assert not got[0].isEmpty() and "stream-ranked" not in written
    assert written.count("to-rank") <= 3  # of no row, for the columns, of the empty file that a stream begins with, and of the batch


SEARCH = "https://www.amazon.in/s?k={0}"
NEXT = '<nav><a href="{0}">Next</a></nav>'


def test_many_searches(spark):
    def page(k, price, to):
        return CARD.format(k, price, k) + (NEXT.format(to) if to else "")

    stored_pages = html_pages(
        spark, (SEARCH.format("a"), page(10, 90, "/s?k=a&page=2")), (SEARCH.format("a") + "&page=2", page(11, 95, "/s?k=a&ref=x")), (SEARCH.format("b"), page(12, 50, "/s?k=b&page=2")), (SEARCH.format("c"), page(13, 70, "/dp/B0ABCDEF13")),
        (SEARCH.format("d"), page(10, 10, "https://www.flipkart.com/search?q=d")), (SEARCH.format("a"), "a copy of a page"), (None, "no url"), ("", ""),
    )
    searches = spark.createDataFrame(
        [(1, SEARCH.format("a"), None, None, 92.0), (2, SEARCH.format("b"), "widget", None, None), (3, SEARCH.format("c"), "umbrella", None, None), (4, SEARCH.format("d"), None, None, None), (5, SEARCH.format("none"), "q", None, None), (6, "#", None, None, None), (7, SEARCH.format("a") + "&ref=z", "widget", None, None)],
        "search bigint, url string, query string, low double, high double",
    )
    found = frontier.crawl(searches, stored_pages)
    ends = {r.search: (r.query, r.pages, r.ended) for r in found.searches.collect()}
    assert ends == {1: ("a", 2, "visited"), 2: ("widget", 1, "no-page"), 3: ("umbrella", 1, "no-link"), 4: ("d", 1, "no-link"), 5: ("q", 0, "no-page"), 6: (None, 0, "empty"), 7: ("widget", 2, "visited")}
    assert sorted((r.search, r.step, r.page) for r in found.visits.collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (7, 1, 0), (7, 2, 1)]
    ranked = sorted((r.search, r["rank"], r.product_id) for r in found.ranked(stored_pages).collect())
    # Search 3 asks for something else; search 1 for "a" alone, which says nothing, up to a price; search 4 for "d", which is in every title.
    assert ranked == [(1, 1, "B0ABCDEF10"), (2, 1, "B0ABCDEF12"), (4, 1, "B0ABCDEF10"), (7, 1, "B0ABCDEF11"), (7, 2, "B0ABCDEF10")]
    assert {r.search: r.pages for r in frontier.crawl(searches, stored_pages, most=1).searches.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}
    none = frontier.crawl(searches.limit(0), stored_pages.limit(0))
    assert none.visits.isEmpty() and none.searches.isEmpty() and none.ranked(stored_pages.limit(0)).isEmpty()


def test_relevance_between_columns(spark):
    titles = ["boAt wireless earbuds bluetooth sound", "phone case for earbuds", "red widget", "", None, "headphone stand", "USB C cables and chargers"]
    asks = ["wireless ear phones under 1500", "earbuds case", "red widgets", "the of", "", None, "bluetooth speaker", "cable"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    for q in asks:
        one = with_relevance(df, q).select("relevance").collect()
        both = df.select(relevance_between(F.col("title"), asked(F.lit(q).cast("string"))).alias("relevance")).collect()
        assert one == both, q


DEEP = 20_000


@pytest.mark.parametrize("inner", ["b", "span", "div"])
def test_deep_pages_of_all_shops(spark, inner):
    deep = f"<{inner}>" * DEEP + "deep" + f"</{inner}>" * DEEP
    pages = html_pages(
        spark, ("https://www.amazon.in/s?k=w", CARD.format(12, 999, 10).replace("</h2>", "</h2>" + deep)),
        ("https://www.flipkart.com/search?q=w", '<div data-id="x"><a class="_4rR01T" href="/w/p/itm1?pid=acc1">steel widget</a>' + deep + '<div class="_30jeq3">₹499</div></div>'),
        ("https://www.meesho.com/search?q=w", '<div data-id="m"><a href="/shirt/p/abc123"><p>cotton kurti</p></a>' + deep + '<span class="priceNow">₹99</span></div>'),
        ("https://www.amazon.in/s?k=w", deep + CARD.format(13, 5, 1)), ("https://www.amazon.in/s?k=w", f"<{inner}>" * DEEP + CARD.format(14, 6, 1)),
    )
    got = sorted((r.title, r.price) for r in sites.extract_products(pages).collect())
    assert got == [("cotton kurti", 99.0), ("steel widget", 499.0), ("widget number 12", 999.0), ("widget number 13", 5.0), ("widget number 14", 6.0)]
    assert sites.unreadable_cards(pages).isEmpty()
    assert sites.scan_pages(pages).count() == 5


def test_one_scan_of_the_pages(spark, tmp_path):
    html_pages(spark, ("https://www.amazon.in/s?k=w", CARD.format(12, 999, 10))).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    for plan in (sites.card_nodes(pages), sites.scan_pages(pages)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("MapInArrow") == 1 and text.count("Relation [") == 1 and "Join" not in text


def test_elements_that_no_rule_reads_give_no_node_rows(spark):
    """A hundred plain elements of a card cost no row; a count, an
    advertisement's mark and a price among them keep theirs."""
    plain = "<span>plain</span><div>text</div><i title='x'></i>" * 100
    shops = [
        ("https://www.amazon.in/s?k=w", CARD.format(12, 999, 10).replace("</h2>", "</h2>" + plain + "<div>7,654 ratings</div><i>Sponsored</i>")),
        ("https://www.flipkart.com/search?q=w", '<div data-id="x"><a class="_4rR01T">steel widget</a>' + plain + "<span>12 Ratings</span><span>3 Reviews</span></div>"),
        ("https://www.meesho.com/search?q=w", '<div data-id="m"><a href="/shirt/p/abc123"><p>cotton kurti</p></a>' + plain + "<i>₹99</i> <span>5 ratings</span></div>"),
    ]
    pages = html_pages(spark, *shops)
    rows = dict(sites.card_nodes(pages).groupBy("page").count().collect())
    assert max(rows.values()) < 40
    got = {r.source: (r.price, r.rating_count, r.review_count, r.sponsored) for r in sites.extract_products(pages).collect()}
    assert got["Amazon"][3] and got["Flipkart"] == (None, 12, 3, False) and got["Meesho"][:2] == (99, 5)


def test_unreadable_cards_are_told(spark, monkeypatch):
    class Broken(Pick):
        def nodes(self, card):
            if "bad" in card.text():
                raise ValueError("bad card")
            return super().nodes(card)

    spec = Spec(lambda root: root.select("li"), (Broken("title", ("b",)),))
    monkeypatch.setattr(sites, "SPECS", {"Amazon": spec, "Flipkart": Spec(lambda root: 1 / 0, ())})
    monkeypatch.setattr(sites, "READERS", {"Amazon": None, "Flipkart": None})
    pages = html_pages(spark, ("https://www.amazon.in/s?k=w", "<li><b>one</b><li>bad<li><b>two</b>"), ("https://www.flipkart.com/s", "<p>x"))
    got = sorted((r.page, r.card, r.reason) for r in sites.unreadable_cards(pages).collect())
    assert got == [(0, 1, "ValueError('bad card')"), (1, -1, "ZeroDivisionError('division by zero')")]
    assert sorted(r.text for r in sites.card_nodes(pages).where("name = 'title'").collect()) == ["one", "two"]


def test_selections_equal_a_plain_walk():
    """Against every ancestor of every node, on pages of random tags."""
    rnd = random.Random(11)
    for _ in range(60):
        html = "".join(rnd.choice(["<div class='x y'>", "<span id=a>", "<p data-k=v>", "<b class=x>", "</div>", "</span>", "</p>", "</b>", "t", " ", "<br>", "<li>", "</ul>", "<ul>"]) for _ in range(80))
        root = parse(html)
        nodes = root.page.nodes[1:]
        fits = lambda n, c: {"div": n.tag == "div", "span": n.tag == "span", ".x": "x" in n.classes, "[data-k]": "data-k" in n.attrs, "#a": n.attrs.get("id") == "a", "*": True}[c]
        for chain in (["div", "span"], [".x", ".x"], ["div", ".x", "[data-k]"], ["#a", "*"], ["*"], [".x"]):
            want = []
            for n in nodes:
                above, left = list(n.above()), list(chain[:-1])
                for up in above:
                    if left and up.order and fits(up, left[-1]):
                        left.pop()
                if fits(n, chain[-1]) and not left:
                    want.append(n)
            assert root.select(" ".join(chain)) == want
            for outer in nodes[:5]:
                assert outer.select(" ".join(chain)) == [n for n in want if outer in list(n.above())]
        for n in nodes:
            assert n.page.trimmed_length(n.first, n.last) == len(n.text().strip())


def test_source_of_stored_pages(spark, tmp_path):
    pages = html_pages(spark, *[("https://www.amazon.in/s?k=w", CARD.format(10 + k, 900 + k, 10)) for k in range(6)], (None, None), ("https://www.flipkart.com/search?q=w", ""))
    pages.repartition(3).write.parquet(str(tmp_path / "p"))
    columns = ["ordinal", "title", "price", "product_id"]
    got = read_products(spark, str(tmp_path / "p")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sites.extract_products(pages).select(columns).collect())) and got.count() == 6
    spark.dataSource.register(ShopPages)
    assert spark.read.format("shop_pages").load(str(tmp_path / "p")).rdd.getNumPartitions() == 3
    pages.select(F.col("page_id").alias("n"), F.col("url").alias("u"), F.col("html").alias("h")).write.parquet(str(tmp_path / "q"))
    assert read_products(spark, str(tmp_path / "q"), page="n", url="u", html="h").count() == 6
    (tmp_path / "none").mkdir()
    assert read_products(spark, str(tmp_path / "none")).isEmpty()


def test_source_of_an_element():
    """What stands between an element's tags, as written, over lines and where tags are missing."""
    root = parse('<p>\nx<h1\n class="a">a &quot;b&quot;&amp;amp</h1>\n<ul><li>1 &lt\n<li><b>2</b></ul><br\n>z<i>&amp')
    assert [root.select(s)[0].source() for s in ("h1", "li", "ul", "br", "i", "p")] == ["a &quot;b&quot;&amp;amp", "1 &lt\n", "<li>1 &lt\n<li><b>2</b>", "", "&amp", "\nx"]


def equals_its_sql(spark, folder, name, columns, **tables):
    """Whether a query over small tables (rows, schema) gives what its SQL does; the rows."""
    import duckdb

    from shelfline.plans.queries import FOUND

    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    query, sql = FOUND[name]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in query(spark, str(folder)).select(*columns).orderBy(columns[0]).collect()] == want


def test_amounts_between_two_hundredths(spark, tmp_path):
    cents = [102500, 103500, 244500, 100500, 123456, 49999500, 244400]
    orders = [(4 * k + f, c / 100) for k, c in enumerate(cents) for f in range(4)]
    equals_its_sql(spark, tmp_path, "format_inr", ["o_orderkey", "price", "count"], orders=(orders, "o_orderkey bigint, o_totalprice double"))


def test_titles_as_they_are_written(spark, tmp_path):
    """Headings with other entities than ampersands, cut ones, none, and no HTML."""
    pages = [(1, '<h1>a&amp;b &quot;c&quot; &amp</h1><h1>d</h1><div class="ad">x</div>'), (2, "<p>no heading</p>"), (3, None), (4, ""), (5, "<h1>x\ny &lt;&lt;</h1>")]
    equals_its_sql(spark, tmp_path, "html_titles", ["page_id", "title", "ads"], pages=([(k, "u", h) for k, h in pages], "page_id bigint, url string, html string"))


def test_a_batch_sets_one_timer_a_key():
    """However many triggers a key has; a timer that has gone off sets the next, and all runs come out."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.timers, self.rows = [], []

        def getListState(self, *_):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            return iter(list(self.rows))

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, quiet, cap = Handle(), 9_000_000, 40_000_000
    settling = settle._Settling("user", quiet, cap)
    settling.init(handle)
    rnd = random.Random(4)
    events = [(t * 1_000_000, rnd.random() < 0.4) for t in rnd.sample(range(400), 120)]
    got, calls = {}, 0
    for part in (events[:70], events[70:]):
        set_before = len(handle.timers)
        list(settling.handleInputRows((1,), iter([pd.DataFrame([(1, None, *e) for e in part])]), handle))
        assert len(handle.timers) == set_before + 1
    while handle.timers:
        handle.now = min(handle.timers)
        handle.timers.remove(handle.now)
        for frame in settling.handleExpiredTimer((1,), handle, None):
            assert not got.keys() & set(frame["started"])
            got |= {s: (e, n) for s, e, n in zip(frame["started"], frame["settled"], frame["grown"], strict=True)}
        calls += 1
    assert got == plain_runs(events, quiet, cap) and not handle.rows and calls < 400
