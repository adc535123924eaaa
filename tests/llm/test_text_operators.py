"""Operators on texts against brute force, with the cases that are defined at
the edges: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import collections
import functools
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfline.llm import exact_dedup, language_id, lm_scoring, mixing, ngram_join, packing, token_counts
from shelfline.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, word string, digest string, slot int, grp int, n int, kept int"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "Ra", "so") for b in ("x", "y.", "z", "", "é")]


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) beside columns that operators use."""
    return spark.createDataFrame([(i, t, lang, s, None, 1, "w", "d", 2, 3, 4, 5) for i, t, lang, s in rows], SCHEMA)


def sample(seed=1):
    r = random.Random(seed)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \t\n ", None, "a"), (3, "one", "de", "b"), (4, "ONE", "de", "b"), (5, "two words", "en", ""), (6, make(5000), "en", "a")]
    for k in range(7, 40):
        rows.append((k, make(r.randrange(1, 60)), r.choice(["en", "de"]), "hot" if k % 3 else f"s{k % 5}"))
    base = make(80).split(" ")
    for k in range(40, 70):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        rows.append((k, (" " if k % 2 else "\n ").join(words), "en", "hot"))
    return rows + [(12, rows[12][1], rows[12][2], rows[12][3]), (80, rows[45][1], "en", "b"), (81, "12345 !!", "en", "b")]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_groups(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = plain_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("parts", "rule"), [(1000, (4, 85, 100)), (3, (4, 85, 100)), (3, (5, 80, 100))])
def test_ngram_join(spark, monkeypatch, parts, rule):
    monkeypatch.setattr(ngram_join, "PART_SETS", parts)
    rows = sample()
    got = ngram_join.join_groups(docs(spark, [*rows, (None, "one", "en", "a")]), ngram_join.Rule(*rule)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, *rule)
    assert len(got) == len({r[0] for r in rows})


def test_ngram_join_without_rows_and_keep_one(spark):
    assert ngram_join.join_groups(docs(spark, []), ngram_join.NEAR).isEmpty()
    rows = [*sample(), (None, "one", "en", "a")]
    groups = brute_groups([r for r in rows if r[0] is not None], 5, 80, 100)
    kept = ngram_join.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    want = [i for i, *_ in rows if i is None or groups[i][1] == i]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("many", [300, 1200])
def test_ngram_join_of_a_passage_in_unlike_documents(spark, monkeypatch, many):
    """Documents that share a passage whose n-grams the first order does not
    know as frequent: they are told apart by their other n-grams, and the rows
    of each round grow with the documents, not with their square."""
    r = random.Random(many)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(many):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        rows.append((k, " ".join([*own[:30], passage, *own[30:]]), "en", "hot"))
        if k % 10 == 0:
            rows.append((many + k, " ".join([*own[:30], passage, *own[30:59], "other"]), "en", "hot"))
    r.shuffle(rows)
    written = collections.Counter()

    def stored(df, name, *rest):
        table = ngram_stored(df, name, *rest)
        written[name] = max(written[name], table.count())
        return table

    ngram_stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", stored)
    monkeypatch.setattr(ngram_join, "PART_SETS", 20)
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    got = ngram_join.join_groups(docs(spark, rows), ngram_join.Rule(4, 85, 100)).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - many if i >= many else i for i, *_ in rows}
    assert written["outside"] >= many  # the case is met
    assert written["met-apart"] <= 20 * many
    assert written["placed-again"] <= many


def test_prefix_tree_finds_every_component():
    rule = ngram_join.Rule(4, 85, 100)
    for seed in range(60):
        r = random.Random(seed)
        base = [sorted(r.sample(range(60), r.randrange(5, 40))) for _ in range(3)]
        sets = [np.array(sorted(set(b) - set(r.sample(b, r.randrange(0, 4))) | set(r.sample(range(60), r.randrange(0, 3)))), dtype=np.uint64) for b in base for _ in range(6)]
        some = np.array(sorted(r.sample(range(60), 20)), dtype=np.uint64)
        known = ngram_join.Order(some, np.array([r.randrange(4, 9) for _ in some]), some.astype(np.int64))
        a, b, part = ngram_join._join(np.arange(len(sets)), sets, rule, known)
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if 100 * both >= 85 * (len(x) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(len(sets)):
                assert (find(i) == find(j)) == (part[i] == part[j])


def test_links_of_a_group_are_stars():
    """A chain of sets, each near the next, is joined to its smallest
    document, so its links need no rounds to become flat."""
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in range(30)]
    known = ngram_join.Order(sets[0][:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    a, b, _ = ngram_join._join(np.arange(100, 130)[::-1].copy(), sets, ngram_join.Rule(4, 85, 100), known)
    assert sorted(zip(a, b, strict=True)) == [(k, 100) for k in range(101, 130)]


def test_filter_of_documents_is_fetched_in_one_job(spark):
    wanted = spark.range(0, 3000, 3).select(F.col("id").alias("doc")).repartition(40)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("filter", "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        only = ngram_join._only(wanted)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("filter")) < 10
    left = set(only(pa.RecordBatch.from_arrays([pa.array(range(3000), type=pa.int64())], names=["doc"]))["doc"].to_pylist())
    assert left >= set(range(0, 3000, 3)) and len(left) < 1500


def test_stars(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, r.randrange(101, 140)) for _ in range(40)] + [(200, 200)]
    got = {x.doc: x.comp for x in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {b: 100 for a, b in edges if a == 100}


def brute_dedup(rows):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    return {(i, min(groups[normal(t)]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, *_ in rows}


def test_exact_dedup(spark):
    rows = sample()
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = index.add(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got} == brute_dedup(rows)
    assert sum(r.kept for r in got) == len({r.digest for r in got}) == index.rows().count()
    # A second batch meets what the first has left, also through a new handle on the folder.
    again = exact_dedup.DigestIndex(spark, index.path, 4).add(docs(spark, [(900, "one", "en", "a"), (901, "new text", "en", "a"), (902, "new  text", "en", "a")]))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in again.collect()} == {(900, 3, 1, False), (901, 901, 2, True), (902, 901, 2, False)}
    assert index.rows().groupBy("digest").count().where("count > 1").isEmpty()
    assert index.add(docs(spark, [])).isEmpty()
    # Of rows repeated over many tasks one stays, of those with a null id too.
    many = docs(spark, [(950, "hot", "en", "a")] * 40 + [(None, "hot", "en", "a")] * 5 + [(None, "colder", "en", "a")] * 5).repartition(6)
    stay = [(r.doc_id, r.keep_id, r.group_size) for r in index.add(many).collect() if r.kept]
    assert sorted(stay, key=str) == [(950, 950, 45), (None, None, 5)]
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, 8)
    assert exact_dedup.DigestIndex(spark, index.path).buckets == 4


def test_index_of_many_batches_is_rewritten(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BATCHES", 2)
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 1)
    index = exact_dedup.DigestIndex(spark)
    assert index.rows().isEmpty()
    seen, buckets = {}, []
    for batch in range(6):
        rows = [(10 * batch + k, f"text {(batch * 7 + k * k) % 23}", "en", "a") for k in range(5)]
        got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(docs(spark, rows)).collect()}
        for i, t, *_ in rows:
            seen.setdefault(t, i)
        assert got == {i: (seen[t], seen[t] == i) for i, t, *_ in rows}
        buckets.append(index.buckets)
        index = exact_dedup.DigestIndex(spark, index.path)
    assert buckets == sorted(buckets) and buckets[-1] > buckets[0]
    files = {f.rsplit("/", 1)[0] for f in index.rows().inputFiles()}
    assert len(files) <= 2 and index.rows().count() == len(seen)


def test_index_is_merged_in_its_order(spark):
    """The large table is read in its order, neither shuffled nor sorted."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(docs(spark, sample()))
    index.add(docs(spark, [(700 + k, f"more {k}", "en", "a") for k in range(20)]))
    groups = index.rows().select("digest", F.col("keep_id").alias("first_id"))

    def plan_of(ordered):
        old = spark.conf.get(exact_dedup.ORDERED)
        spark.conf.set(exact_dedup.ORDERED, ordered)
        try:
            plan = index._met(groups)._jdf.queryExecution().executedPlan().toString().split("\n")
        finally:
            spark.conf.set(exact_dedup.ORDERED, old)
        return plan

    counts = [sum("Sort [" in line for line in plan_of(o)) for o in ("false", "true")]
    exchanges = sum("Exchange" in line for line in plan_of("true"))
    # What is left is the sort of the batch.
    assert counts == [3, 1] and exchanges <= 2


def test_batch_that_was_appended_and_not_recorded(spark, monkeypatch):
    rows, more = sample(), [(900, "one", "en", "a"), (901, "new text", "en", "a"), (902, "new  text", "en", "a"), (None, "newer", "en", "a")]

    def crashing(index, batch):
        def crash():
            raise RuntimeError("lost")

        monkeypatch.setattr(index, "_record", crash)
        with pytest.raises(RuntimeError):
            index.add(docs(spark, batch))
        return exact_dedup.DigestIndex(spark, index.path)

    index = crashing(exact_dedup.DigestIndex(spark, buckets=4), rows)
    assert index.rows().isEmpty()
    index.add(docs(spark, rows))
    again = crashing(exact_dedup.DigestIndex(spark, index.path), more)
    plain = lambda out: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str)
    assert plain(again.add(docs(spark, more))) == plain(again.add(docs(spark, more))) == sorted([(900, 3, 1, False), (901, 901, 2, True), (902, 901, 2, False), (None, None, 1, True)], key=str)
    assert again.rows().groupBy("digest").count().where("count > 1").isEmpty() and exact_dedup.DigestIndex(spark, index.path).batches == again.batches


def test_keep_first(spark):
    rows = [*sample(), (None, "lonely", "en", "a"), (7, "another text of the same id", "en", "a")]
    for given in (rows, [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in (7, 12)]):
        kept = exact_dedup.keep_first(docs(spark, given))
        assert kept.columns == docs(spark, []).columns
        texts = [exact_text(r.text) for r in kept.collect()]
        assert len(texts) == len(set(texts)) and set(texts) == {exact_text(t) for _, t, *_ in given}


def exact_text(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ODD = ["don't we'll I'VE they're o'clock 'tis rock''s", "a b　c​d", "😀👍🏽 中文字 Жжß İΣς", "x" * 700, "-" * 300, " " * 99, "\r\n\r\n\tz", "<|endoftext|> in <|endoftext|>", "<|startoftext|>Ａｂ", "１２３ ½ ²", "é́ ﬁ", "'s's'", " 's"]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    rows = sample() + [(100 + k, t, "en", "a") for k, t in enumerate(ODD)] + [(None, "abc", "en", "a")]
    want = [(i, len((t or "").encode()), len(Tokenizer.from_file(path).encode(t or "").ids)) for i, t, *_ in rows]
    got = [tuple(r) for r in token_counts.count_tokens(docs(spark, rows), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs(spark, []), path).isEmpty()


def library_counts(path, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("chunk", "stretch"), [(4096, 1 << 20), (1, 1 << 20), (2, 7), (3, 40), (7, 1000), (50, 130)])
def test_state_maps_compose(chunk, stretch):
    path = tokenizer("byte_bpe_50k.json")
    machine = token_counts.transducer(path)
    r = random.Random(5)
    texts = ODD + ["aaaa'sss''s" * 9, "=-" * 90, "ab" * 150, "ÃÂ" * 100] + ["".join(r.choice(a) for _ in range(r.randrange(1, 90))) for a in ("aes t'mn\n  .9é", "ab", "-= ", "thequickbrown", "中é😀 a") for _ in range(30)]
    assert machine.counts(texts, chunk, stretch) == library_counts(path, texts)


def test_map_holds_every_state():
    machine = token_counts.transducer(tokenizer("byte_bpe_50k.json"))
    # Within a piece the state at a cut is open: the map of a chunk answers for whatever the text before leads to.
    one = machine.state_maps([("x" * machine.around[0], "thequickbrown", "fox")])[0]
    assert len(one) > 1 and all(place <= 0 for place, _ in one) and (0, -1) not in one
    # Where a piece ends, all states become one.
    assert list(machine.state_maps([("x" * machine.around[0], "thequick brown", " ")])[0].values()) == [{(0, -1): n} for to in machine.state_maps([("x" * machine.around[0], "thequick brown", " ")])[0].values() for n in to.values()]


def test_one_long_piece_goes_to_several_tasks(spark):
    r = random.Random(6)
    path = tokenizer("byte_bpe_50k.json")
    rows = [(1, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5_000_000)), "en", "a"), (1, "-" * 3_000_000, "en", "a"), (2, "a<|endoftext|>" * 100_000, "en", "a"), (None, "b", "en", "a")]
    began = time.time()
    got = [tuple(x) for x in token_counts.count_tokens(docs(spark, rows), path).collect()]
    assert time.time() - began < 180
    assert sorted(got, key=str) == sorted(((i, len(t), n) for (i, t, *_), n in zip(rows, library_counts(path, [t for _, t, *_ in rows]), strict=True)), key=str)


def test_packing(spark):
    from tokenizers import Tokenizer

    path, size = tokenizer("word_bpe_49k.json"), 64
    rows = sample() + [(100 + k, t, "en", "a") for k, t in enumerate(ODD)]
    got = packing.pack(docs(spark, rows), path, size).collect()
    ids = {i: np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t, *_ in rows}
    n_rows = collections.Counter(i for i, *_ in rows)
    by_doc, by_sequence = collections.Counter(), collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * size and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        by_doc[r.doc_id] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc == {i: len(x) * n_rows[i] for i, x in ids.items()}
    for runs in by_sequence.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= size
    total = sum(by_doc.values())
    assert len(by_sequence) <= -(-total // size) + 2
    assert packing.pack(docs(spark, []), path).isEmpty()


def test_solution_is_close_to_the_best():
    for seed in range(150):
        r = np.random.default_rng(seed)
        size = int(r.integers(5, 40))
        counts = np.bincount(r.integers(1, size + 1, int(r.integers(1, 120))), minlength=size + 1)
        used, bins = np.zeros(size + 1, dtype=int), 0
        for runs, times in packing.solve(counts, size):
            assert sum(length * n for length, n in runs) <= size
            bins += times
            for length, n in runs:
                used[length] += n * times
        assert (used == counts).all()
        least = max(-(-int((counts * np.arange(size + 1)).sum()) // size), int(counts[size // 2 + 1 :].sum()))
        assert bins <= math.ceil(least * 11 / 9) + 1


def fewest(lengths, size):
    """The least number of sequences: over all sets of pieces, sequences used and room taken in the last."""
    best = [(0, size)] + [(len(lengths) + 1, 0)] * (2 ** len(lengths) - 1)
    for chosen in range(1, 2 ** len(lengths)):
        for k, length in enumerate(lengths):
            if chosen >> k & 1:
                n, used = best[chosen ^ 1 << k]
                best[chosen] = min(best[chosen], (n, used + length) if used + length <= size else (n + 1, length))
    return best[-1][0]


def test_packing_against_the_optimum():
    spent = least = 0
    for seed in range(150):
        r = np.random.default_rng(seed)
        size = int(r.integers(6, 30))
        lengths = r.integers(1, size + 1, int(r.integers(1, 10))).tolist()
        counts = np.bincount(lengths, minlength=size + 1)
        want = fewest(lengths, size)
        fixed, rest = packing.reduce(counts, size)
        # What the reduction fixes is in some best solution.
        left = [length for length, n in enumerate(rest.tolist()) for _ in range(n)]
        assert sum(times for _, times in fixed) + fewest(left, size) == want, (lengths, size)
        bins = sum(times for _, times in packing.solve(counts, size))
        assert want <= bins <= want + 1, (lengths, size)
        spent, least = spent + bins, least + want
    assert spent <= 1.01 * least


def brute_base(train, texts):
    counts = collections.Counter(w for t in train for w in [*plain_words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for t in texts:
        tokens = [*plain_words(t), None]
        yield len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)


@pytest.mark.parametrize("held", [1 << 19, 8, 0])
def test_lm_scoring(spark, monkeypatch, held):
    monkeypatch.setattr(lm_scoring, "HELD", held)
    rows = sample()
    table = docs(spark, rows)
    fold = language_id.in_fold(F.col("doc_id"), 7, 2)
    model, counts = lm_scoring.train(table.where(~fold))
    got = lm_scoring.score(table, model, counts, fold).collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_base([t for i, t, *_ in rows if not out(i)], [t for _, t, *_ in rows])
    want = sorted((i, out(i), n, known, total, round(base, 6)) for (i, *_), (n, known, total, base) in zip(rows, want, strict=True))
    assert sorted((r.doc_id, r.extra, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # Probabilities of all words, one unknown word of each class included, add up to one.
    of_words = collections.Counter({lm_scoring.CLASSES: model.ends + 1})
    for r in counts.collect():
        of_words[r["class"]] += r.n + 1
    for before in range(len(model.log_next)):
        total = sum(10 ** (model.log_next[before, c] - model.log_total[c]) * (of_words[c] + 1) for c in range(len(model.log_next)))
        assert abs(total - 1) < 1e-9


def test_lm_scoring_without_training(spark):
    table = docs(spark, sample()[:8])
    model, counts = lm_scoring.train(table.limit(0))
    got = lm_scoring.score(table, model, counts, F.lit(True)).collect()
    assert len(got) == 8 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert lm_scoring.score(docs(spark, []), model, counts, F.lit(True)).isEmpty()


def classes_of(counts):
    """The class of each word of the training text, by hash."""
    return {r.word % 2**64: r["class"] for r in counts.collect()}


@functools.cache
def hash_of(word):
    return int(next(lm_scoring.words_of(pa.array([word])))[-1][0])


@pytest.mark.parametrize("held", [1 << 19, 1110, 0])
def test_all_words_are_classed_by_context(spark, monkeypatch, held):
    monkeypatch.setattr(lm_scoring, "HELD", held)
    r = random.Random(4)
    fill = [f"f{k}" for k in range(1100)]
    one, two = ([*(f"{c}{k}" for k in range(8)), *(f"{c}{k}xyz" for k in range(8, 40))] for c in "ab")
    texts = ["the {} of " * 6, "to {} it " * 6]
    rows = [(k, " ".join(f"p {r.choice(fill)} q" for _ in range(600)), "en", "a") for k in range(60)] + [(60, None, "en", "a")]
    for k in range(240):
        kind = (one, two)[k % 2]
        words = [*r.sample(kind[:8], 5), kind[8 + k // 2 % 32]]
        rows.append((100 + k, texts[k % 2].format(*words), "en", "a"))
    model, counts = lm_scoring.train(docs(spark, rows))
    of = classes_of(counts)
    # One ending, two kinds of words: the rare ones, not among the WORDS most frequent, follow the frequent ones of their kind.
    first, second = ({of[hash_of(w)] for w in words[8:]} for words in (one, two))
    assert not first & second
    # What is held and what is joined changes no class.
    monkeypatch.setattr(lm_scoring, "HELD", 8)
    assert classes_of(lm_scoring.cluster(docs(spark, rows))[1]) == of
    # The transitions are those of the classes the words have.
    table = np.full(model.log_next.shape, lm_scoring.TRANSITION_PRIOR)
    for _, t, *_ in rows:
        seen = [64, *(of[hash_of(w)] for w in plain_words(t)), 64]
        for x, y in zip(seen, seen[1:], strict=False):
            table[x, y] += 1
    assert np.allclose(model.log_next, np.log10(table / table.sum(axis=1, keepdims=True)))
    # Scores are those of whole class sequences; unseen words go by their ending.
    n = {r.word % 2**64: r.n for r in counts.collect()}
    given = [*rows[55:70], (500, "the unseenxyz of b11xyz neverxyz a11xyz f3", "en", "a"), (501, "neverxyz", "en", "a"), (502, "a12xyz b22xyz", "en", "a")]
    got = {r.doc_id: r.score for r in lm_scoring.score(docs(spark, given), model, counts, F.lit(True)).collect()}
    ending = int(lm_scoring._endings(np.frombuffer(b"xyz", dtype=np.uint8), np.array([0]), np.array([3]))[0])
    for i, t, *_ in given:
        h = [hash_of(w) for w in plain_words(t)]
        seen = [64, *(of.get(x, model.endings[ending]) for x in h), 64]
        want = sum(math.log10(n.get(x, 0) + 1) for x in h) + math.log10(model.ends + 1)
        want += sum(math.log10(0.75 * 10 ** (model.log_next[x, y] - model.log_total[y]) + 0.25 / (model.tokens + model.distinct + 1)) for x, y in zip(seen, seen[1:], strict=False))
        assert abs(got[i] - want) < 1e-6


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_class_model_beats_word_counts(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    fold = language_id.in_fold(F.col("doc_id"), 7, 2)
    model, counts = lm_scoring.train(table.where(~fold))
    score, base = lm_scoring.score(table, model, counts, fold).where("extra").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base + 0.03 * abs(base)


def test_exchange_finds_classes():
    table = np.zeros((7, 7))
    for a in range(3):
        table[a, 3:6] = 50 + a
        table[3 + a, :3] = 40 + a
    table[6, :3] = 5
    of = lm_scoring.exchange(table, 2)
    assert len({*of[:3]}) == len({*of[3:6]}) == 1 and of[0] != of[3] and of[6] == 2


def test_language_id(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language_id.in_fold(F.col("doc_id"), 5, 0)
    model = language_id.learn(table.where(~fold))
    got = language_id.identify(table, model).join(table.select("doc_id", "lang", fold.alias("out")), "doc_id").where("out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.95
    assert got.where("score < 0 or score > 1").isEmpty()
    # Edges, with the same model.
    edge = {r.doc_id: r for r in language_id.identify(docs(spark, sample()), model).collect()}
    assert [(edge[k].lang_pred, edge[k].score) for k in (0, 1, 2, 81)] == [("und", 0.0)] * 4
    assert language_id.identify(docs(spark, []), model).isEmpty()
    # Halves of two languages are a mixture of the two.
    one = {lang: table.where(f"lang = '{lang}' and n_chars between 3000 and 9000").orderBy("doc_id").first().text for lang in ("de", "es")}
    mixed = model.infer([one["de"][:1500] + " " + one["es"][:1500], one["de"]])
    assert 0.3 < mixed[1][0] < 0.7 and model.names[mixed[0][1]] == "de" and mixed[1][1] > 0.9
    kept = language_id.keep_identified(table, model)
    assert kept.columns == table.columns
    # What goes has no letter, or no language with half of it; each is named.
    gone = table.join(kept.select("doc_id"), "doc_id", "left_anti").collect()
    best, _, own = model.infer([r.text or "" for r in gone])
    assert [r.doc_id for r, b, o in zip(gone, best, own, strict=True) if b >= 0 and o >= 0.5] == []
    plain = [r.doc_id for r in gone if any(c.isalpha() for c in r.text or "")]
    assert len(plain) <= 1, plain
    # Short texts in one language stay, whatever the doubt which one it is.
    short = docs(spark, [(1, "A.", "en", "a"), (2, "no", "en", "a"), (3, "12 !", "en", "a"), (4, None, "en", "a"), (None, "ok", "en", "a")])
    assert sorted(map(str, (r.doc_id for r in language_id.keep_identified(short, model).collect()))) == ["1", "2", "None"]


def plain_inference(model, text):
    """Expectation-maximisation and set choice for one text, in plain Python."""
    _, buckets = language_id._trigrams([text])
    seen = sorted(collections.Counter(buckets.tolist()).items())
    if not seen:
        return -1, 0.0, 0.0
    like = {b: model.likelihood[b].tolist() for b, _ in seen}
    langs, size = range(len(model.names)), sum(n for _, n in seen)

    def em(within):
        theta = [1 / len(within) if k in within else 0.0 for k in langs]
        for _ in range(language_id.ROUNDS):
            new = [0.0] * len(theta)
            for b, n in seen:
                z = sum(like[b][k] * theta[k] for k in langs)
                for k in langs:
                    new[k] += n * like[b][k] * theta[k] / z
            theta = [x / size for x in new]
        return theta, sum(n * math.log(sum(like[b][k] * theta[k] for k in langs)) for b, n in seen)

    single = [sum(n * math.log(like[b][k]) for b, n in seen) for k in langs]
    cost = math.log(size + 1) / 2
    mixture, fit = em(set(langs))
    top = max(langs, key=lambda k: (single[k], -k))
    chosen, value = [float(k == top) for k in langs], single[top]
    sets = [([float(k == j) for k in langs], single[j]) for j in langs]
    order = sorted(langs, key=lambda k: (-mixture[k], k))
    for m in range(2, len(order) + 1):
        if fit - cost <= value:
            break
        theta, gained = em(set(order[:m]))
        gained -= cost * (m - 1)
        sets.append((theta, gained))
        if gained > value:
            chosen, value = theta, gained
    best = max(langs, key=lambda k: (chosen[k], -k))
    highest = max(v for _, v in sets)
    weights = [math.exp(v - highest) for _, v in sets]
    return best, sum(w * p[best] for w, (p, _) in zip(weights, sets, strict=True)) / sum(weights), chosen[best]


def test_language_inference_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(table)
    by_lang = {r.lang: r.text for r in table.where("n_chars between 900 and 3000 and lang is not null").dropDuplicates(["lang"]).collect()}
    texts = [r.text or "" for r in table.where("n_chars < 1500").orderBy("doc_id").limit(60).collect()] + ["", "A.", "no", "12", "ok ok"]
    langs = sorted(by_lang)
    texts += [by_lang[a][:300] + " " + by_lang[b][:n] for a in langs for b in langs for n in (60, 300) if a != b]
    texts.append(" ".join(by_lang[lang][:200] for lang in langs))
    best, share, own = model.infer(texts)
    for k, text in enumerate(texts):
        want = plain_inference(model, text)
        assert (best[k], round(share[k], 6), round(own[k], 6)) == (want[0], round(want[1], 6), round(want[2], 6)), text


def test_language_id_learns_nothing(spark):
    model = language_id.learn(docs(spark, [(0, None, "en", "a"), (1, "abc", None, "a")]))
    assert {r.lang_pred for r in language_id.identify(docs(spark, sample()), model).collect()} == {"und"}
    assert language_id.keep_identified(docs(spark, sample()), model).isEmpty()


def test_mixing(spark):
    rows = [(i, t, lang, s) for i, t, lang, s in sample()]
    table = docs(spark, rows)
    sizes, counts = collections.Counter(), collections.Counter()
    for i, t, _, s in rows:
        sizes[s or ""] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
        counts[(i, s or "")] += 1
    uses = mixing.mix(table, max_epochs=2.0).collect()
    by_source = collections.Counter()
    for r in uses:
        by_source[r.source] += r.n_tokens
    # Every document is read, at most as often as allowed and one more.
    epochs = collections.Counter((r.doc_id, r.source) for r in uses)
    assert set(epochs) == set(counts) and max(epochs.values()) <= 2
    assert {r.doc_id: r.same_rows for r in uses}[12] == 2
    weight = {r.source: r.weight for r in uses}
    assert abs(sum(weight.values()) - 1) < 1e-9
    spread = [weight[s] / sizes[s] for s in sizes]
    assert max(spread) / min(spread) <= 2.0 + 1e-6
    budget = max(sizes[s] / weight[s] for s in sizes)
    for s, used in by_source.items():
        longest = max(r.n_tokens for r in uses if r.source == s)
        assert weight[s] * budget - 1e-3 <= used < weight[s] * budget + longest + 1e-3
    assert all(0 <= r.mix_key < 1 for r in uses)
    # The same rows again for the same seed, others for another.
    key = lambda u: sorted((r.doc_id or -1, r.epoch, round(r.mix_key, 9)) for r in u)
    assert key(mixing.mix(table, max_epochs=2.0).collect()) == key(uses)
    out = mixing.mixed(table, max_epochs=2.0)
    assert out.columns == table.columns
    assert collections.Counter((r.doc_id, r.source or "") for r in out.collect()) == {k: n * counts[k] for k, n in epochs.items()}


def spark_hash(*values):
    """Spark's xxhash64 of values (format, value); a text has no format."""
    seed = 42
    for kind, value in values:
        seed = xxhash.xxh64(struct.pack(kind, value) if kind else value.encode(), seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def brute_mix(rows, most, seed, block_docs):
    """Every use of a document, by reading the permuted blocks one after another."""
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s or "", i] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    tokens = collections.Counter()
    for (s, _), n in sizes.items():
        tokens[s] += n
    top = max(tokens.values())
    low, high = 0.0, 1.0
    for _ in range(30):
        a = (low + high) / 2
        spread = [(n / top) ** (a - 1) for n in tokens.values()]
        low, high = (a, high) if max(spread) / min(spread) > most else (low, a)
    raised = {s: (n / top) ** high for s, n in tokens.items()}
    z, need = sum(raised.values()), max(tokens[s] / raised[s] for s in tokens)
    n_blocks = max(1, len(sizes) // block_docs)
    out = {}
    for s, n in tokens.items():
        epochs = max(raised[s] * need / n, 1.0)
        reach, at = n * epochs, 0
        blocks = collections.defaultdict(list)
        for (source, i), size in sizes.items():
            if source == s:
                blocks[spark_hash(("<i", seed), ("", s), ("<q", i)) % n_blocks].append((i, size))
        for epoch in range(max(math.ceil(round(epochs, 9)), 1)):
            for b in sorted(blocks, key=lambda b: (spark_hash(("<i", seed), ("<i", epoch), ("", s), ("<q", b)), b)):
                for i, size in sorted(blocks[b], key=lambda d: (spark_hash(("<i", seed), ("<i", epoch), ("<q", d[0])), d[0])):
                    if at < reach - 1e-6:
                        out[i, s, epoch] = (size, round(at / reach, 6), round(raised[s] / z, 6))
                    at += size
    return out


@pytest.mark.parametrize(("most", "seed", "block_docs"), [(1.5, 17, 1000), (2.0, 3, 4), (3.5, 17, 1)])
def test_mixing_against_brute_force(spark, monkeypatch, most, seed, block_docs):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block_docs)
    rows = [r for r in sample() if r[0] is not None]
    got = {(r.doc_id, r.source, r.epoch): (r.n_tokens, round(r.mix_key, 6), round(r.weight, 6)) for r in mixing.mix(docs(spark, rows), max_epochs=most, seed=seed).collect()}
    assert got == brute_mix(rows, most, seed, block_docs)


def test_mixing_to_an_entropy(spark):
    table = spark.createDataFrame([(f"s{k}", 10 ** (k + 1)) for k in range(4)], "source string, tokens bigint")
    share = np.array([10.0 ** (k + 1) for k in range(4)])
    for wanted in (0.5, 1.0, 1.3):
        alpha = mixing.exponent(table, entropy=wanted)
        w = share**alpha / (share**alpha).sum()
        assert abs(-(w * np.log(w)).sum() - wanted) < 1e-4
    assert mixing.exponent(table.limit(0)) == 1.0
    assert mixing.mix(docs(spark, [])).isEmpty() and mixing.mixed(docs(spark, [])).isEmpty()


def test_mixing_within_a_budget(spark):
    table = docs(spark, [(k, "w " * 10, "en", "hot" if k < 60 else "cold") for k in range(80)])
    uses = mixing.mix(table, max_epochs=1.5, budget=300.0).collect()
    total = collections.Counter()
    for r in uses:
        total[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in uses}
    assert all(300 * weight[s] - 1e-6 <= n < 300 * weight[s] + 10 for s, n in total.items())


def test_profile_of_many_grams_is_small():
    """What a task of the n-gram join holds while it counts does not grow with its texts."""
    import tracemalloc

    class Mapped:
        def mapInArrow(self, rows, _):
            return rows

    rows = ngram_join._profile(Mapped(), ngram_join.Rule(4, 85, 100))
    words = np.random.default_rng(5)

    def batches():
        for k in range(16):
            texts = [" ".join(map(str, words.integers(0, 10**9, 2000))) for _ in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array(range(100 * k, 100 * k + 100)), pa.array(texts)], names=["doc", "text"])

    tracemalloc.start()
    found = sum(batch.num_rows for batch in rows(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1600 and peak < 150e6
