"""Vector codes, source divergence and personal data, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import divergence, pii, queries, vector_codes

VECTORS = "vec_id bigint, embedding array<double>, label int, code string, salt string, of string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x") for i, v, label in rows], VECTORS)


def brute_codes(rows, parts, entries, rounds, scale=256):
    """The contract in plain Python's integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[(v + [0] * (m * parts))[p * m : (p + 1) * m] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = collections.defaultdict(list)
            for row in cut:
                of[nearest(p, row[p])[1]].append(row[p])
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else entry for e, entry in enumerate(books[p])])
        books = new
    found = [[nearest(p, row[p]) for p in range(parts)] for row in cut]
    errors, labels = [sum(d for d, _ in f) for f in found], collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    most = (1 << 63) - 1
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), min(e, most), min(labels[label], most), digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "ragged"])
def test_vector_codes(spark, kind):
    rnd = random.Random(kind)
    if kind == "plain":
        rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([1, 1, 2, None])) for i in range(300)]
    elif kind == "ties":
        rows = [(i // 2, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(8)], 1) for i in range(200)] + [(None, [0.0] * 8, None), (3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [math.nan] * 8, 1), (6, [math.inf] * 8, 1)]
        rows += rows[:20]
    elif kind == "large":
        rows = [(i, [rnd.choice([0.5, 1e8, -3e15, 1e17, 1e30]) * rnd.random() for _ in range(8)], i % 3) for i in range(60)] + [(100, [1e200] * 8, 7)]
    else:
        rows = [(i, [rnd.gauss(0, 1) for _ in range(rnd.choice([0, 1, 5, 6]))], 1) for i in range(80)]
    got = as_rows(vector_codes.compress(vectors(spark, rows), parts=4, entries=16))
    assert got == brute_codes(rows, 4, 16, 2)


def test_vector_codes_without_rows(spark):
    assert as_rows(vector_codes.compress(vectors(spark, []))) == []
    assert as_rows(vector_codes.compress(vectors(spark, [(1, None, 1), (2, [math.nan], 1)]))) == []


def test_annulus_is_exact_and_prunes():
    rnd = np.random.default_rng(5)
    book = vector_codes.Book(rnd.integers(-300, 300, (64, 4)).astype(object))
    parts = rnd.integers(-300, 300, (5000, 4))
    codes, errors = book.nearest(parts)
    entries = book.sorted[np.argsort(book.order)]
    gaps = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == gaps.argmin(axis=1)).all() and (errors == gaps.min(axis=1)).all()
    one = [book._one([int(x) for x in p]) for p in parts[:300]]
    assert one == list(zip(codes[:300].tolist(), errors[:300].tolist(), strict=True))


def brute_audit(rows, least, ranks):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))] for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(s, w) for (_, la, s), w in zip(rows, words, strict=True) if la == lang]
        docs = collections.Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if docs[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share(sum(counts.values(), collections.Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize(("station", "block", "chunk"), [(1, 3, 1), (3, 7, 2), (8, 4096, 16)])
def test_divergence(spark, monkeypatch, station, block, chunk):
    for name, value in (("STATION", station), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(station)
    vocabulary = ["the", "And", "éÉ", "naïve", "x", "日本", "zebra", "Q", "over", "alpha", "beta", "gamma", "delta"]
    rows = [(" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 9))) + rnd.choice(["", ".", " don't 3x4"]), rnd.choice(["en", "de", None]), rnd.choice([f"s{k}" for k in range(7)] + [None])) for _ in range(150)]
    rows += rows[:10] + [(None, "en", "empty"), ("", "xx", "a"), ("only", "xx", "b"), ("1 2 3", "xx", None), ("tie tie", "yy", "one")]
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "text string, lang string, source string, block string, part string")
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=3, ranks=4).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, 3, 4)


def test_divergence_without_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_every_station_meets_every_other_once(spark):
    for n in range(1, 10):
        rows = spark.range(n).select(divergence._hosted(divergence.F.col("id").cast("int"), divergence.F.lit(n)).alias("to"), "id").collect()
        met = [(r.id, t.station, t.round) for r in rows for t in r.to]
        assert sorted(tuple(sorted(m[:2])) for m in met) == list(itertools.combinations(range(n), 2))
        assert all((a + b) % n == r for a, b, r in met)
        hosts = collections.Counter(b for _, b, _ in met)
        assert not n % 2 or all(hosts[i] == (n - 1) // 2 for i in range(n))


def test_counts_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SLICE", 4)
    texts = ["one two three four", "", "two two", "Äpfel z"] * 3
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 12, "source": ["a", "b"] * 6})
    total, parts = collections.Counter(), 0
    for out in divergence._counted(iter([batch])):
        parts += 1
        for r in out.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    want = collections.Counter((s, w) for s, t in zip(["a", "b"] * 6, texts, strict=True) for w in t.replace("Äpfel", "Äpfel").split())
    assert parts > 1 and {k: n for k, n in total.items() if k[1]} == dict(want) and {k[0] for k in total} == {"a", "b"}


def test_shares_are_exact():
    rnd = random.Random(2)
    for total in (7, 10**9 + 7, 9 * 10**14, 1 << 60):
        n = [rnd.randrange(0, total + 1) for _ in range(50)] + [0, total]
        assert divergence.shares(np.array(n), total).tolist() == [1 + 10**9 * x // total for x in n]


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
            fine = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    rnd = random.Random(3)
    pieces = ["a@b.co", "x.y+z@mail-1.example.com", "@", "a@b", "a@b@c.d.e", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (555) 010-9999", "+49 30 123456", "+1", " ", "-", "(", ")", "7", "é", "😀", "word", "12", "\n", "…@x.y"]
    for _ in range(3000):
        text = "".join(rnd.choices(pieces, k=rnd.randrange(0, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    for text in ("5" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1 " * 50_000, "a@" * 50_000):
        pii.base_spans(text)  # in time that grows with the length


def spans_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_personal_data(spark):
    rnd = random.Random(4)
    rows = [(i, f"{rnd.choice(['write to', 'so', 'the'])} n{i}.x@mail{i % 7}.example.com and {rnd.randrange(1, 224)}.{i % 256}.7.9, +1 (555) 010-{1000 + i} or 411111111111111{rnd.randrange(10)} end") for i in range(300)]
    card = "4111111111111111"
    cases = {
        900: (f"pay {card} 4012888888881881 now", [f"card:4:{4 + 16}", "card:21:37"]),
        901: ("call +1 (843) 555-7672 170.106.47.218 now", ["ip:23:37", "phone:5:22"]),
        902: ("mail jane.doe [at] example [dot] com today", ["email:5:36"]),
        903: ("we meet at example.com in 2019, 123 456 7890 pages", []),
        904: ("order 4111111111111112 and token 1234567890123456", []),
        905: ("version 999.1.2.3 of 300 400 5000", []),
        906: (None, []),
        907: ("", []),
        908: ("nothing here but words and 42 numbers", []),
    }
    rows += [(i, t) for i, (t, _) in cases.items()] + [(None, "a@b.co"), (None, None), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "s", "s", "s") for i, t in rows], "doc_id bigint, text string, spans string, found string, id string")
    out = pii.find(docs)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id is None:
            continue
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}
    for i, (text, want) in cases.items():
        found = [s for r in got if r.doc_id == i for s in r.spans.split(",") if s]
        assert found == want, (i, text)
    assert sorted(r.spans for r in got if r.doc_id is None) == ["", "email:0:6"]
    for r in got:
        if r.doc_id == 901:
            assert pii.redacted(texts[901], r.spans) == "call [PHONE] [IP] now"
    assert pii.redacted(None, "") is None


def test_personal_data_without_rows(spark):
    assert pii.find(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert [r.spans for r in pii.find(spark.createDataFrame([(1, "no data")], "doc_id bigint, text string")).collect()] == [""]


def test_reliabilities_are_found():
    """Labelers of known reliability vote on candidates of known truth; all
    are proposals, on which the pattern and the validity say nothing."""
    rng = np.random.default_rng(1)
    n = 4000
    truth = rng.random(n) < 0.4
    right = [None, None, 0.9, 0.75, 0.85, 0.8]
    votes = np.zeros((n, 6), dtype=np.int64)
    for k, r in enumerate(right):
        if r is not None:
            says = rng.random(n) < r
            votes[:, k] = np.where(rng.random(n) < 0.8, np.where(truth == says, pii.YES, pii.NO), pii.ABSTAINS)
    model = pii._estimate(np.full(n, 2), votes, np.ones(n))
    for k, r in enumerate(right):
        if r is not None:
            assert abs(model.reliability[2, k, 1] - r) < 0.05 and abs(model.reliability[2, k, 0] - (1 - r)) < 0.05
    assert abs(model.prior[2, 0] - 0.4) < 0.04
    assert ((model.posterior(np.full(n, 2), votes) > 0.5) == truth).mean() > 0.9


def test_personal_data_query(spark):
    sf = "/root/testdata/sf0.001"
    got = spans_of(queries.op13_personal_data(spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        said = [f"{k}:{a}:{b}" for k, a, b in brute_base(r.text)]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(got[r.doc_id].spans.split(",")) | {""}
