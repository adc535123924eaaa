"""Operators against plain folds, on tables and random rows."""

import os
import pathlib
import random
import shutil
import subprocess
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.operators import dedup, filters, ranking
from shelfline.plans import inputs, pipeline
from shelfline.plans.queries import rows
from shelfline.plans.storage import shared_dir
from shelfline.schema import RAW_PRODUCT, raw_products
from shelfline.sources.dom import parse
from shelfline.sources.sites import extract_products
from shelfline.streaming.incremental import Crawl, rank_files

SMALL = "/root/testdata/sf0.001"


def table(spark, products):
    names = [c.strip().split(" ")[0] for c in RAW_PRODUCT.split(",")]
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in products], RAW_PRODUCT)


def product(k, **fields):
    return {"ordinal": k, "title": f"Product {k}", "asin": f"B{k:09d}", "product_id": f"B{k:09d}", "price": 500.0, "rating": 4.0, "review_count": 1000.0, "is_sponsored": False, "sponsored": False, "source": "Amazon"} | fields


def fold(products):
    """Copies folded one after another."""
    def complete(p):
        counted = any(c and c > 0 for c in (p.get("review_count"), p.get("rating_count")))
        return bool(p.get("title")) + 2 * bool(p.get("price") and p["price"] > 0) + bool(p.get("rating") and p["rating"] > 0) + 3 * counted + bool(p.get("image_url"))

    kept = {}
    for p in sorted(products, key=lambda p: p["ordinal"]):
        key = p.get("asin") or p.get("canonical_url") or p["ordinal"]
        old = kept.get(key)
        if old is None:
            kept[key] = p | {"at": p["ordinal"]}
        elif old["is_sponsored"] != p["is_sponsored"]:
            kept[key] = (p if old["is_sponsored"] else old) | {"at": old["at"]}
        elif complete(p) > complete(old):
            kept[key] = p | {"at": old["at"]}
    return sorted((p["at"], p["price"] or 0, p.get("review_count") or 0, p["is_sponsored"]) for p in kept.values())


FIELDS = st.fixed_dictionaries({
    "asin": st.sampled_from([None, "", "B000000001", "B000000002"]), "price": st.sampled_from([None, 0.0, 5.0, 9.0]), "review_count": st.sampled_from([None, 0.0, 7.0]), "rating": st.sampled_from([None, 4.0]),
    "is_sponsored": st.booleans(), "image_url": st.sampled_from([None, "x"]), "canonical_url": st.sampled_from([None, "u"]),
})


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FIELDS, max_size=12))
def test_dedup_is_a_fold(spark, fields):
    products = [product(k) | f for k, f in enumerate(fields)]
    got = dedup.deduplicate(table(spark, products)).collect()
    assert sorted((r.ordinal, r.price or 0, r.review_count or 0, r.is_sponsored) for r in got) == fold(products)


def test_dedup_goldens(spark):
    a = product(0, is_sponsored=True, price=1.0, asin="B000000001")
    b = product(1, is_sponsored=False, price=2.0, asin="B000000001")
    for pair in ([a, b], [a | {"ordinal": 1}, b | {"ordinal": 0}]):
        assert [r.price for r in dedup.deduplicate(table(spark, pair)).collect()] == [2.0]
    poor = product(0, price=None, review_count=None, asin="B000000001")
    assert [(r.ordinal, r.price) for r in dedup.deduplicate(table(spark, [poor, b])).collect()] == [(0, 2.0)]
    assert dedup.deduplicate(table(spark, [])).isEmpty()


def test_rank_and_pages(spark):
    shuffled = [product(k, review_count=float(random.Random(k).randrange(5)) or None) for k in range(50)]
    ranked = ranking.with_rank(filters.validate(table(spark, shuffled))).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 51))
    order = sorted(ranked, key=lambda r: r["rank"])
    assert [(-(r.feedback_volume or -1), r.ordinal) for r in order] == sorted((-(r.feedback_volume or -1), r.ordinal) for r in ranked)
    pages = [r.ordinal for p in range(1, 14) for r in sorted(ranking.page(filters.validate(table(spark, shuffled)), p).collect(), key=lambda r: r["rank"])]
    assert pages == [r.ordinal for r in order]
    assert ranking.page(filters.validate(table(spark, shuffled)), 0).isEmpty()
    assert ranking.page(filters.validate(table(spark, shuffled)), 99).isEmpty()


def test_ranking_goldens(spark):
    rank = lambda products, **o: [r.ordinal for r in sorted(pipeline.rank_products(table(spark, products), **o).collect(), key=lambda r: r["rank"])]
    assert rank([product(k, review_count=c) for k, c in enumerate((5000.0, 20000.0, 10000.0))]) == [1, 2, 0]
    assert rank([product(0, title="USB Cable", review_count=1e5), product(1, title="Wireless AirPods", review_count=5e3)], query="wireless airpods") == [1]
    assert rank([product(0, review_count=None), product(1, review_count=1e4), product(2, review_count=None)]) == [1, 0, 2]
    assert rank([product(0, price=999.0), product(1, price=2999.0), product(2, price=None), product(3, price=-50.0), product(4, price=float("nan"))], low=600, high=1500) == [0]
    assert rank([product(0, price=None, review_count=9e5), product(1)]) == [0, 1]
    assert rank([product(0, review_count=0.0), product(1, review_count=None)]) == [0, 1]


def test_filters_commute(spark):
    valid = filters.validate(dedup.deduplicate(rows(spark, SMALL, inputs.PRODUCTS))).cache()
    steps = [lambda d: filters.relevant(d, "red widget"), lambda d: filters.in_budget(d, 905, 915), filters.organic]
    results = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        out = valid
        for k in order:
            out = steps[k](out)
        results.add(tuple(sorted(r.ordinal for r in out.collect())))
    assert len(results) == 1


def test_append_and_new_rows(spark):
    first, second = table(spark, [product(0), product(1)]), table(spark, [product(0, asin="B000000005", product_id="B000000005"), product(1)])
    assert sorted(r.ordinal for r in dedup.append(first, second).collect()) == [0, 1, 2, 3]
    assert [r.asin for r in dedup.new_rows(first, second).collect()] == ["B000000005"]
    assert dedup.new_rows(first, first).isEmpty()
    assert dedup.append(table(spark, []), second).count() == 2


def test_selectors():
    root = parse('<div id="a" class="x y"><p>one<p><b data-k="v w">two</b></div><ul><li>1<li>2</ul><br><img src="q">')
    assert [n.text() for n in root.select("p")] == ["one", "two"]
    assert [n.text() for n in root.select('div.x.y [data-k*="w"], li')] == ["two", "1", "2"]
    assert root.select("#a b")[0].attrs == {"data-k": "v w"}
    assert not root.select("div li")
    assert [n.attrs for n in root.select("img[src]")] == [{"src": "q"}]


CARD = '<div data-component-type="s-search-result" data-asin="B0ABCDEF{0}"><h2><a href="/x/dp/B0ABCDEF{0}"><span>Sponsored widget number {0}</span></a></h2><span class="a-price"><span class="a-offscreen">₹{1}</span></span><span>{2} ratings</span></div>'


def html_pages(spark, *pages):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")


def test_extraction(spark):
    pages = html_pages(spark, ("https://www.amazon.in/s?k=w", CARD.format(12, 999, "1,234") + CARD.format(13, "1,099", 7)), ("https://www.amazon.in/s", None), ("https://www.amazon.in/s", ""), ("https://unknown.example/", "<p>no card"))
    got = sorted(extract_products(pages).collect(), key=lambda r: r.ordinal)
    assert [(r.title, r.price, r.rating_count, r.asin, r.sponsored) for r in got] == [("widget number 12", 999.0, 1234.0, "B0ABCDEF12", False), ("widget number 13", 1099.0, 7.0, "B0ABCDEF13", False)]


def test_short_title_among_much_white_space_is_widened(spark):
    wide = '<h2><span>Foo{0}Bar</span></h2>'
    card = '<div data-component-type="s-search-result" data-asin="B0ABCDEF12"><div>' + wide + '<i> in a box that says rather more of it</i></div></div>'
    titles = [r.title for r in extract_products(html_pages(spark, ("https://www.amazon.in/s?k=w", card.format(" ")), ("https://www.amazon.in/s?k=w", card.format(" " * 45)))).collect()]
    assert titles == ["Foo Bar in a box that says rather more of it"] * 2


def test_crawl(spark):
    next_link = '<nav><a href="/s?k=widget&page={0}">Next</a></nav>'
    site = {
        "https://www.amazon.in/s?k=widget": CARD.format(12, 999, 10) + next_link.format(2), "https://www.amazon.in/s?k=widget&page=2": CARD.format(13, 999, 99) + next_link.format(3),
        "https://www.amazon.in/s?k=widget&page=3": CARD.format(13, 999, 99) + '<nav><a href="/s?k=widget&page=2&ref=x">Next</a></nav>',
    }
    crawl = Crawl(spark, lambda url: html_pages(spark, (url, site[url])))
    ranked = sorted(crawl.run("https://www.amazon.in/s?k=widget").collect(), key=lambda r: r["rank"])
    assert [r.product_id for r in ranked] == ["B0ABCDEF13", "B0ABCDEF12"]
    assert crawl.pages == 3 and crawl.query == "widget" and not crawl.read("https://www.amazon.in/s?k=widget#x")


@pytest.mark.parametrize("name", ["ranked_products", "full_pipeline", "price_stats", "canonical_page_url", "page_cards", "html_card_kinds", "html_next_links", "price_insights_html", "typed_search_query"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    from shelfline.plans.queries import FOUND

    run, sql = FOUND[name]
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    got = run(spark, SMALL)
    assert sorted(got.columns) == columns
    clean = lambda rows: sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert clean(got.select(columns).collect()) == clean(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    want = entry.queries()["full_pipeline"](spark, SMALL)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and not got.isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_works_without_the_training_data_part(tmp_path, pipeline):
    root = pathlib.Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    run = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q) and len(q) > 50"
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_relevance_normalises_once(spark):
    plan = filters.relevant(table(spark, [product(0)]), "wireless ear phones under 1500")._jdf.queryExecution().optimizedPlan().toString()
    # One chain of four replacements of the title, and one squeeze where nothing is left of it.
    assert plan.count("[^a-z0-9]+") == 1 and plan.count("regexp_replace(") <= 7


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_rank_within_groups(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    r = random.Random(2)
    rows_ = [product(k, source=r.choice(["hot", "hot", "hot", "cold", None]), review_count=float(r.randrange(4)) or None) for k in range(120)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {row.ordinal: (row["rank"], row.page) for row in ranking.with_rank(table(spark, rows_), ["source"]).collect()}
        assert ranking.with_rank(table(spark, []), ["source"]).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for source in ("hot", "cold", None):
        order = sorted((-(p["review_count"] or -1), p["ordinal"]) for p in rows_ if p["source"] == source)
        assert [got[o] for _, o in order] == [(k + 1, k // 4 + 1) for k in range(len(order))]


def test_stream_without_rows_keeps_the_last_ranking(spark, tmp_path):
    schema = table(spark, []).schema
    stream = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    (tmp_path / "none").mkdir()
    none = rank_files(spark, stream("none"))
    assert none.isEmpty() and {"rank", "page", "ordinal"} <= set(none.columns)
    table(spark, [product(0, price=5.0)]).coalesce(1).write.parquet(str(tmp_path / "some"))
    got = rank_files(spark, stream("some"), low=1.0)
    assert [row["rank"] for row in got.collect()] == [1] and got.columns == none.columns
    assert rank_files(spark, stream("some"), low=100.0).isEmpty()


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session(), "x")


def test_raw_products_fills_missing(spark):
    assert raw_products(spark.range(1).select(F.col("id").alias("ordinal"))).first().title is None
