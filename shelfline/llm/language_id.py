"""Language identification as inference of a mixture.

A language is a distribution over hashed character trigrams, learned from
labelled texts.  A document is a mixture of languages: expectation-maximisation
estimates their proportions from the likelihoods of its trigrams.  Which
languages take part is chosen by penalised likelihood: a further one must gain
more than it costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import mix64, text_slices
from shelfline.llm.pretokens import LETTER, class_table, code_points

#: Buckets of hashed trigrams.
BUCKETS = 1 << 14
#: Texts whose trigrams are counted side by side.
ROWS = 256
#: Rounds of expectation-maximisation.
ROUNDS = 12
#: Added to every count of a trigram in a language.
PRIOR = 0.5
#: The name given where no language can be told.
UNKNOWN = "und"


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; false
    for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the trigram around each letter; what is no letter
    counts as a gap."""
    _, codes, offsets = code_points([t.lower() for t in texts])
    letter = class_table()[codes] == LETTER
    at = np.flatnonzero(letter)
    c = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    rows = np.searchsorted(offsets, at, "right") - 1
    before, after = c[at], c[at + 2]
    before[np.isin(at, offsets[:-1])] = 0
    after[np.isin(at + 1, offsets[1:])] = 0
    h = mix64(c[at + 1] | before << np.uint64(21) | after << np.uint64(42))
    return rows, (h >> np.uint64(50)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for first, last, data, offsets in text_slices(column):
        whole = data.tobytes()
        texts = [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for k in range(0, len(texts), ROWS):
            yield first + k, min(first + k + ROWS, last), texts[k : k + ROWS]


class Languages:
    """Names and the likelihoods of the trigrams, [buckets, languages]."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.array([counts[n] for n in self.names], dtype=np.float64).reshape(len(self.names), BUCKETS) + PRIOR
        table /= table.sum(axis=1, keepdims=True)
        # Per bucket relative to the likeliest language: mixtures compare alike, sums stay in range.
        self.likelihood = np.ascontiguousarray((table / table.max(axis=0, initial=1e-300)).T)

    def infer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the number of the predicted language (-1: none, as there
        is no letter or nothing was learned), its share weighted over the
        language sets by their penalised likelihood, and its proportion in the
        chosen set alone."""
        n_lang, n = len(self.names), len(texts)
        best, share, own = np.full(n, -1), np.zeros(n), np.zeros(n)
        rows, buckets = _trigrams(texts)
        if not len(rows) or not n_lang:
            return best, share, own
        table = np.bincount(rows * BUCKETS + buckets, minlength=n * BUCKETS)
        keys = np.flatnonzero(table)
        count, like, row = table[keys].astype(np.float64), self.likelihood[keys % BUCKETS], keys // BUCKETS
        there, begins = np.unique(row, return_index=True)
        size = np.add.reduceat(count, begins)
        local = np.searchsorted(there, row)
        cost = np.log(size + 1) / 2  # of a further language
        single = np.add.reduceat(count[:, None] * np.log(like), begins)
        mixture, fit = self._em(like, count, local, begins, size, np.ones((len(there), n_lang), dtype=bool))
        top = np.argmax(single, axis=1)
        values, shares = [single[:, k] for k in range(n_lang)], [np.eye(n_lang)[[k] * len(there)] for k in range(n_lang)]
        chosen, value = np.eye(n_lang)[top], single[np.arange(len(there)), top]
        # Sets of the 2, 3, ... languages of the largest proportions, where all together could pay.
        order = np.argsort(-mixture, axis=1, kind="stable")
        for m in range(2, n_lang + 1):
            open_ = np.flatnonzero(fit - cost > value)
            if not len(open_):
                break
            within = np.zeros((len(open_), n_lang), dtype=bool)
            np.put_along_axis(within, order[open_, :m], True, axis=1)
            some = np.flatnonzero(np.isin(local, open_))
            part = np.searchsorted(open_, local[some])
            _, at = np.unique(part, return_index=True)
            found, gained = self._em(like[some], count[some], part, at, size[open_], within)
            gained = gained - cost[open_] * (m - 1)
            better = gained > value[open_]
            chosen[open_[better]], value[open_[better]] = found[better], gained[better]
            all_value, all_share = np.full(len(there), -np.inf), np.zeros((len(there), n_lang))
            all_value[open_], all_share[open_] = gained, found
            values.append(all_value)
            shares.append(all_share)
        predicted = np.argmax(chosen, axis=1)
        weight = np.exp(np.array(values) - np.max(values, axis=0))
        held = np.array([s[np.arange(len(there)), predicted] for s in shares])
        best[there] = predicted
        share[there] = np.clip((weight * held).sum(axis=0) / weight.sum(axis=0), 0.0, 1.0)
        own[there] = chosen.max(axis=1)
        return best, share, own

    @staticmethod
    def _em(like, count, local, begins, size, within) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages ``within`` each row's set, and the
        log-likelihood they reach."""
        theta = within / within.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = like * theta[local]
            joint *= (count / joint.sum(axis=1))[:, None]
            theta = np.add.reduceat(joint, begins) / size[:, None]
        return theta, np.add.reduceat(count * np.log((like * theta[local]).sum(axis=1)), begins)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Trigram counts of all rows with a text and a label.

    The languages are taken to be few: to the driver come BUCKETS counts of
    each.  Null texts and labels teach nothing.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for first, last, texts in _texts(batch["text"]):
                row, bucket = _trigrams(texts)
                names, number = np.unique(langs[first:last].astype(str), return_inverse=True)
                table = np.bincount(number[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, seen in zip(names.tolist(), table, strict=True):
                    counts[name] = counts.get(name, 0) + seen
        for name, seen in counts.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["lang", "bucket", "n"])

    taught = labelled.selectExpr(f"cast(`{lang_col}` as string) as lang", f"`{text_col}` as text").where("lang is not null and text is not null")
    table = taught.mapInArrow(rows, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = table.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    counts = {}
    for row in found.collect():
        counts[row.lang] = np.zeros(BUCKETS)
        counts[row.lang][row.bucket] = row.n
    return Languages(counts)


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row, from its text alone.

    A null text or one without a letter gets ``und`` and 0, as do all where
    nothing was learned.  Ties go to the language first by name.  A text is
    read whole, however long.  Repeated rows get a row each, null ids stay
    null, an empty table gives no row; other columns play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: Languages = held.value
        names = np.array([*languages.names, UNKNOWN], dtype=object)
        for batch in batches:
            for first, last, texts in _texts(batch["text"]):
                best, share, _ = languages.infer(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, last - first), pa.array(names[best], type=pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"]
                )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(rows, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Languages, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, in which one language of the
    chosen set has at least the proportion ``least``.  Texts without letters go,
    null ones too, and those that mix languages without a main one; a text whose
    chosen set is one language stays, however short and doubtful.  Null ids and
    repeated rows stay as they are, texts are read whole, an empty table stays
    empty; where nothing was learned nothing stays."""
    from pyspark.sql.types import StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for first, last, texts in _texts(batch.column(place)):
                best, _, own = held.value.infer(texts)
                keep[first:last] = (best >= 0) & (own >= least)
            yield batch.filter(pa.array(keep))

    # By number, as names may hold dots.
    schema = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    return docs.toDF(*schema.names).mapInArrow(rows, schema).toDF(*docs.columns)
