"""Operators on pages, vectors and keys, and the pipeline."""

import base64
import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import queries, sharding, topk, warc
from shelfline.plans.storage import shared_dir

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, payload string, value string, uri string, response_id string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], PAGES)


def read_back(spark, table, least=0):
    path = shared_dir(spark, "archives")
    warc.write_captures(table, path, least, file_bytes=100_000)
    return path, warc.captures(spark, path)


def test_warc_round_trip(spark):
    tricky = "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a.example/x?y=1", "<p>é 中 😀</p>"), (2, None, None), (3, "http://a.example/\r\nX: y", tricky), (4, "", ""), (5, "u", tricky), (6, "u", "q" * 300_000), (7, "u", tricky), (7, "u", tricky)]
    path, got = read_back(spark, pages(spark, rows))
    got = got.select("response.*", "request", "metadata").collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    assert len(got) == len(rows)
    for r in got:
        number = int(bytes(r.metadata[0].payload).split(b":")[1])
        payload = next((h or "") for i, _, h in rows if i == number).encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r.payload_bytes == len(payload)
        assert r.warc_type == ("response" if last[payload.decode()] == number else "revisit")
        assert r.request.warc_type == "request" and r.request.concurrent_to == r.record_id and len({m.record_id for m in r.metadata}) == 1
        if r.warc_type == "response":
            assert bytes(r.payload) == payload and r.digest_ok and r.http_status == 200
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert len(files) > 1  # the long payload fills a file
    assert all(gzip.decompress(f.content).startswith(b"WARC/1.1\r\n") for f in files)


def test_warc_query_with_repeated_pages(spark, tmp_path):
    rows = [(7, "u", "h"), (7, "u", "h"), (3, "u", "h"), (9, "u", "g"), (9, "u", "k"), (4, "u", "k"), (12, "u", "g")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    last = {}
    for i, _, h in rows:
        last[h] = max(i, last.get(h, 0))
    want = [(i, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, _, h in rows]
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in queries.op7_warc_assembly(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_least_size_and_no_rows(spark):
    _, got = read_back(spark, pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3)
    assert collections.Counter(r[0] for r in got.select("response.warc_type").collect()) == {"response": 3, "revisit": 1}
    _, none = read_back(spark, pages(spark, []))
    assert none.isEmpty()


def test_warc_reads_other_archives(spark):
    record = lambda kind, extra, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    one = record("response", "WARC-Record-ID: <r>\r\nContent-Type: application/http;\r\n msgtype=response\r\n", b"HTTP/1.1 404 No\r\nContent-Length: 2\r\n\r\nhi")
    data = gzip.compress(record("warcinfo", "", b"x: y")) + gzip.compress(one) + gzip.compress(record("metadata", "WARC-Concurrent-To: <r>\r\n", b"")) + gzip.compress(one[:60])
    found = list(warc.parse(warc._unzipped(data)))
    assert [r["warc_type"] for r in found] == ["warcinfo", "response", "metadata"]
    assert (found[1]["http_status"], found[1]["payload"], found[1]["digest_ok"]) == (404, b"hi", None)
    rows = [(r["warc_type"], r["record_id"], r["concurrent_to"], r["payload"]) for r in found] + [("request", None, "<nowhere>", b"")]
    got = warc.assemble(spark.createDataFrame(rows, "warc_type string, record_id string, concurrent_to string, payload binary")).collect()
    assert len(got) == 1 and got[0].request is None and len(got[0].metadata) == 1


def test_records_are_parsed_in_small_blocks(monkeypatch):
    record = lambda n: f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode() + bytes(random.Random(n).choices(b"WARC/1.\r\n", k=n)) + b"\r\n\r\n"
    sizes = [0, 5, 3000, 17, 900]
    plain = b"junk WARC/" + b"".join(record(n) for n in sizes)
    want = [(r["place"], r["payload"]) for r in warc.parse(plain)]
    assert [len(payload) for _, payload in want] == sizes
    for step in (1, 7, 1000):
        monkeypatch.setattr(warc, "STEP", step)
        zipped = gzip.compress(plain[:40]) + b"".join(gzip.compress(plain[k : k + 1500]) for k in range(40, len(plain), 1500))
        for data in (plain, gzip.compress(plain), zipped):
            assert [(r["place"], r["payload"]) for r in warc.parse(warc._unzipped(data))] == want
        # What is cut off within a record ends the archive before it.
        assert [r["payload"] for r in warc.parse(warc._unzipped(gzip.compress(plain)[:-40]))] == [payload for _, payload in want][: len(sizes) - 1]


def test_warc_query(spark):
    got = queries.op7_warc_assembly(spark, SMALL).collect()
    table = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    last = {}
    for i, h in table.items():
        last[h] = max(i, last.get(h, i))
    want = {(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in table.items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def brute_top(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * float(np.float32(x))) for x in v]
            vectors[i] = min(w, vectors.get(i, w))
    out = set()
    for q in vectors:
        if q % every == 0:
            most = 2**63 - 1
            best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(vectors[q], vectors[c], strict=True)))), c) for c in vectors if c != q and len(vectors[c]) == len(vectors[q]))[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize(("block", "scale"), [(1024, 1.0), (5, 1.0), (5, 400.0), (7, 1e8), (7, 1e15)])
def test_top_k(spark, monkeypatch, block, scale):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(7)
    rows = [(k, [r.uniform(-1, 1) * scale for _ in range(6)]) for k in range(60)]
    rows += [(60 + k, [0.5, 0.25, 0.0, 0.0, -1.0, 1.0]) for k in range(30)] + [(90, None), (91, [None] * 6), (92, [float("nan")] * 6), (93, [float("inf")] * 6), (94, [1.0, 2.0]), (95, [1.0, 3.0]), (100, []), (101, [])]
    rows += [rows[3], (3, [9.0] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, block int")
    got = topk.top_k(table, 7, lambda i: i % 5 == 0).collect()
    assert {tuple(x) for x in got} == brute_top(rows, 7, 5) and len(got) == len({tuple(x) for x in got})


def test_top_k_beyond_64_bits(spark):
    """A component or a score beyond 64 bits counts as the nearest integer."""
    rows = [(0, [0.5, 1e8]), (1, [1.0, 0.0]), (2, [1e30, 0.0]), (3, [-1e30, 1.0]), (20, [1e30, -1e30]), (21, [1e300, 1e300])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 9, lambda i: i % 20 == 0).collect()
    most = 2**63 - 1
    vectors = {i: [max(-most - 1, min(most, math.floor(64 * x) if abs(x) < 1e300 else int(x))) for x in v] for i, v in rows}
    want = {(q, c): max(-most, min(most, sum(a * b for a, b in zip(vectors[q], vectors[c], strict=True)))) for q in (0, 20) for c in vectors if c != q}
    assert {(r.query_id, r.vec_id): r.score for r in got} == want
    for q in (0, 20):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == sorted((c for c in vectors if c != q), key=lambda c: (-want[q, c], c))


def test_top_k_without_rows(spark):
    table = spark.createDataFrame([(3, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.top_k(table, 5, lambda i: i % 2 == 0).isEmpty()
    assert topk.top_k(table.limit(0), 5, lambda i: i % 2 == 0).isEmpty()


def brute_table(names, size):
    """Every shard's whole permutation, then turns."""
    lists = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        lists.append([(start + k * skip) % size for k in range(size)])
    table = [None] * size
    while None in table:
        for shard, order in enumerate(lists):
            if None in table:
                table[next(s for s in order if table[s] is None)] = shard
    return table


def test_lookup_table():
    names = [f"n{k}" for k in range(7)]
    assert sharding.lookup_table(names, 101).tolist() == brute_table(names, 101)
    table = sharding.lookup_table(queries.SHARDS)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    # Of the slots that a lost shard did not hold few move.
    fewer = sharding.lookup_table(queries.SHARDS[:-1])
    assert ((table != fewer) & (table != 63)).mean() < 0.05
    weighted = np.bincount(sharding.lookup_table(["a", "b"], 1009, [3.0, 1.0]))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05
    for bad in (([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b"], 11, [1.0, 0.0])):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placing(spark):
    rows = [(k if k % 7 else None, "x", 1) for k in range(50)] + [(3, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, slot string, Shard int")
    got = sharding.place(table, "doc_id", queries.SHARDS).collect()
    lookup = sharding.lookup_table(queries.SHARDS)
    place = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    assert sorted(map(str, ((r.doc_id, r.slot, r.shard) for r in got))) == sorted(map(str, ((i, place(i), int(lookup[place(i)])) for i, *_ in rows)))
    assert sharding.place(table.limit(0), "doc_id", queries.SHARDS).isEmpty()
    assert sharding.place(table.withColumn("__slot", F.lit("own")), "doc_id", queries.SHARDS).first()["__slot"] == "own"
    # A key by one of the two names is read before it is replaced.
    for key in ("slot", "shard"):
        named = spark.createDataFrame([("k1", "z"), (None, "z"), ("k" * 100_000, "z")], f"{key} string, other string")
        got = sharding.place(named, key, queries.SHARDS).collect()
        want = [int(lookup[int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]) for k, _ in named.collect()]
        assert sorted(r.shard for r in got) == sorted(want) and got[0].other == "z"


def test_write_sharded(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    sharding.write_sharded(table, "doc_id", queries.SHARDS[:4], f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == table.count() and back.select("shard").distinct().count() == 4
    edge = spark.createDataFrame([(None, "x", 1), (None, "x", 1), ("a", None, None)], "shard string, slot string, `a.b` int")
    sharding.write_sharded(edge, "shard", queries.SHARDS[:4], f"file://{tmp_path}/edge")
    assert spark.read.parquet(f"file://{tmp_path}/edge").count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SMALL).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048 and {r.doc_id for r in out} <= set(rows)
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, SMALL)
        assert stage.columns == docs.columns, name
    kept = collections.Counter(r.doc_id for r in stage.collect())
    assert set(kept) == {r.doc_id for r in out}
    # Brute force over the two stages that drop copies: no two kept texts are alike.
    from tests.llm.test_text_operators import brute_groups, exact_text

    groups = brute_groups([(i, rows[i]) for i in kept], 5, 80, 100)
    assert all(i == comp for i, (_, comp) in groups.items())
    every = brute_groups(list(rows.items()), 5, 80, 100)
    assert len({exact_text(rows[i]) for i in kept}) == len(kept)
    clean = [i for i, (_, comp) in every.items() if comp == i and any(c.isalpha() for c in rows[i])]
    assert len(set(clean) & set(kept)) >= 0.95 * len(clean)


def test_pipeline_at_the_edges(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import docs, sample

    docs(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
    long = " ".join(f"wort{k}" for k in range(300_000))
    rows = [*sample(), (None, "a text without an id, of its own", "en", None), (None, None, None, None), (200, long, "de", "b"), (200, long, "de", "b"), (12, "another text of the same id", "en", "b")]
    docs(spark, rows).write.parquet(str(tmp_path / "edge/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "edge")).collect()
    kept = {r.doc_id for r in got}
    assert None in kept and 200 in kept and not kept & {0, 1, 2, 81} and kept <= {i for i, *_ in rows}
    # Of exact copies the smallest id stays, and of the repeated long text one row, read as often as its source is.
    assert not kept & {4, 80} and 3 in kept
    epochs = {r.start for r in got if r.doc_id == 200}
    assert sum(r.doc_id == 200 for r in got) % len(epochs) == 0 and max(collections.Counter(r.start for r in got if r.doc_id == 200).values()) <= 2


#: Names that the operators use inside.
INSIDE = [
    "id", "doc", "digest", "text_", "row", "gone", "uses", "use", "of_source", "source_", "kept", "keep_id", "group_size", "lang_pred", "score", "salt", "rank", "piece", "length", "part", "block", "epoch", "tokens", "weight", "mix_key",
    "__id", "__digest", "__text", "__gone", "__uses", "__use", "__source", "component_id", "n_shingles", "n_tokens", "same_rows", "first_id", "range", "a.b",
]


def test_stages_pass_columns_of_any_name(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import sample

    rows = [*sample()[:12], (0, "another text of an id that is there", "en", "b"), (None, "a text without an id", "en", None)]
    table = spark.createDataFrame([(*r, *[f"{n}{k}" for n in INSIDE]) for k, r in enumerate(rows)], f"doc_id bigint, text string, lang string, source string, {', '.join(f'`{n}` string' for n in INSIDE)}")
    given = {tuple(r) for r in table.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SMALL)
        if name == "best_fit_packing":
            assert out.count() >= len(rows)
        else:
            got = out.collect()
            assert out.columns == table.columns and got and {tuple(r) for r in got} <= given, name


def test_registered(spark):
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert queries.op10_sharding(spark, SMALL).agg(F.countDistinct("shard")).first()[0] > 40
