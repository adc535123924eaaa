"""Personal data in texts, by weak supervision.

Strict patterns find the base spans, which always stay.  Looser ones propose
candidates besides: addresses with the signs spelled out, what a strict pattern
swallowed together with its neighbour, numbers written in other ways.  On each
candidate labelers vote: its pattern, its validity, a gazetteer, the words
before it, the signs around it, and whether it looks made up.

How far a labeler can be relied on is not known but estimated, by
expectation-maximisation over the votes on all candidates of all texts; what
that says of each pattern of votes trains the final classifier of spans, a
logistic regression over votes, lengths and the word before.  Candidates that
it accepts join the base spans.  Both learn from one table of counts, whose
size the number of labelers bounds, not the number of texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from shelfline.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "valid", "gazetteer", "context", "around", "made_up")
ABSTAINS, YES, NO = 0, 1, 2
#: Classes of the word before a candidate, and of its length: with the votes
#: at most 4 * 3^6 * 16 * 8 different rows.
WORDS, LENGTHS = 16, 8
#: Signs before a candidate in which words are looked for.
BEFORE = 40
#: What the label model's opinion of a pattern of votes weighs in the classifier.
EVERY = 0.05
#: Steps of the classifier's fit, and its penalty on squared weights.
STEPS, RIDGE = 20, 0.02
#: Rounds of expectation-maximisation; votes (right, wrong) and candidates
#: (personal data, not) that count before any is seen.
ROUNDS, PRIOR, DOUBT = 60, (8.0, 2.0), (1.0, 4.0)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits, as it would have begun before.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_AT = re.compile(r" ?[\[({<] ?(?:at|AT|At|@) ?[\])}>] ?| (?:at|AT) ")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({<] ?(?:dot|DOT|Dot|\.) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z0-9-]+)+")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_BROKEN_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_OTHER_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}[ ./-][0-9 ()./-]{6,18}[0-9]|\([0-9]{2,5}\)[ .-]?[0-9][0-9 .-]{4,12}[0-9]|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])")

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io ai app dev cloud online shop site eu de fr es it uk us ca mx br ar au nz jp cn in kr ru pl nl be ch at se no dk fi pt ie cz".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 886 961 962 963 964 965 966 971 972".split())
SAYS = {
    "email": frozenset("mail email e-mail mailto contact write correo courriel kontakt adresse dirección".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address client login adresse dirección serveur servidor".split()),
    "card": frozenset("card cards visa mastercard amex credit debit karte kreditkarte carte tarjeta payment paid".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile cell fax handy móvil whatsapp".split()),
}
DENIES = frozenset("order invoice token isbn issn version sku serial ref build hash id doi page chapter bestellnummer rechnung facture pedido factura release".split())

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second from the right doubled and
    its digits added, ends in 0."""
    values = [int(d) for d in digits[::-1]]
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the base pattern, found from their signs, so that a long
    run of letters is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points, end exclusive) of the base patterns,
    by kind and start; matches that fail their test are left out."""
    out = [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if _passes(kind, m.group()):
                out.append((kind, m.start(), m.end()))
    return out


def _passes(kind: str, match: str) -> bool:
    if kind == "ip":
        # Leading zeros aside, a part of over three digits is over 255.
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.split("."))
    digits = _digits(match)
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that are no base spans but may be personal data."""
    for at in _AT.finditer(text):
        start = at.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < at.start() and (end := _SPELLED.match(text, at.end())):
            yield "email", start, end.end()
    if not _DIGIT.search(text):
        return
    if text.count(":") >= 7:
        yield from (("ip", m.start(), m.end()) for m in _IP6.finditer(text))
    if "[.]" in text:
        yield from (("ip", m.start(), m.end()) for m in _BROKEN_IP.finditer(text))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and not _passes("card", m.group()):
            yield from (("card", m.start() + a, m.start() + b) for a, b in _windows(m.group()))
    yield from (("card", m.start(), m.end()) for m in _OTHER_CARD.finditer(text))
    for m in _PHONE.finditer(text):
        if not _passes("phone", m.group()):
            # It swallowed what follows, or more than one number.
            n = 0
            for run in re.finditer(r"[0-9]+", m.group()):
                n += run.end() - run.start()
                if n > 15:
                    break
                if n >= 9:
                    yield "phone", m.start(), m.start() + run.end()
    yield from (("phone", m.start(), m.end()) for m in _OTHER_PHONE.finditer(text))


def _windows(match: str) -> Iterator[tuple[int, int]]:
    """Neighbouring runs of digits, 13 to 19 digits together."""
    runs = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", match)]
    for i, (start, _) in enumerate(runs):
        n = 0
        for a, b in runs[i:]:
            n += b - a
            if n > 19:
                break
            if n >= 13:
                yield start, b


def _vote(yes: bool, no: bool) -> int:
    return YES if yes else NO if no else ABSTAINS


def votes_on(text: str, kind: str, start: int, end: int, base: bool) -> tuple[str, int]:
    """The labelers' votes on a candidate as digits, and the class of the word
    before it."""
    span, digits = text[start:end], _digits(text[start:end])
    words = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])]
    if kind == "email":
        plain = re.sub(r" ?[\[({<]? ?\b(?:at|AT|At)\b ?[\])}>]? ?", "@", re.sub(r" ?[\[({<]? ?\b(?:dot|DOT|Dot)\b ?[\])}>]? ?", ".", span))
        local, _, domain = plain.rpartition("@")
        fine = bool(local) and not re.search(r"^\.|\.\.|\.$", local) and not any(p.startswith("-") or p.endswith("-") or not p for p in domain.split("."))
        last = domain.rpartition(".")[2].lower()
        pattern = _vote(base, not re.search(r"[\[({<]|\b(?:dot|DOT)\b", span))
        valid, known = _vote(fine, not fine), _vote(last in TOP_DOMAINS, not (last.isalpha() and len(last) < 7))
    elif kind == "ip":
        parts = re.split(r"\[?\.\]?", span) if "." in span else []
        pattern, valid = _vote(base, False), _vote(not any(p != "0" and p.startswith("0") for p in parts), True)
        first = int(parts[0]) if parts and len(parts[0]) < 4 else 1
        known = _vote(1 <= first <= 223 or not parts, first in (0, 255))
    elif kind == "card":
        pattern, passes = _vote(base, False), luhn(digits)
        n, issuer = len(digits), int(digits[:4])
        shaped = (issuer // 1000 == 4 and n in (13, 16, 19)) or (n == 16 and (5100 <= issuer < 5600 or 2221 <= issuer <= 2720 or issuer // 100 in (60, 65))) or (n == 15 and issuer // 100 in (34, 37)) or (n == 14 and issuer // 100 in (30, 36, 38))
        valid, known = _vote(passes, not passes), _vote(shaped, True)
    else:
        # Numbers without a sign of a telephone may be anything.
        pattern, valid = _vote(base, span[0] not in "+(" and not span.startswith("00")), _vote(9 <= len(digits) <= 15, True)
        if span.startswith(("+", "00")):
            code = digits.lstrip("0")
            known = _vote(any(code[:k] in CALLING_CODES for k in (1, 2, 3)), True)
        else:
            known = _vote(len(digits) == 10 and digits[0] > "1" and digits[3] > "1", False)
    near = words[-4:]
    context = _vote(any(w in SAYS[kind] for w in near), any(w in DENIES for w in near))
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    glued = any(c.isalnum() or c in "_=#@/\\" for c in sides)
    made_up = len(set(digits)) == 1 if len(digits) > 6 else False
    made_up |= any(run in digits for run in ("01234567", "12345678", "23456789", "98765432"))
    word = 1 + zlib.crc32(words[-1].encode()) % (WORDS - 1) if words else 0
    return "".join(map(str, (pattern, valid, known, context, _vote(not glued, True), _vote(False, made_up)))), word


def _candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """All base spans and proposals with their votes; proposals that meet a
    base span of any kind are none."""
    taken = sorted((start, end) for _, start, end in base)
    starts, ends, most = [s for s, _ in taken], [], 0
    for _, end in taken:
        ends.append(most := max(most, end))
    out, seen = [], set()
    for is_base, (kind, start, end) in [*((True, s) for s in base), *((False, s) for s in _proposals(text))]:
        k = bisect_right(starts, end - 1)
        if (kind, start, end) in seen or (not is_base and k and ends[k - 1] > start):
            continue
        seen.add((kind, start, end))
        votes, word = votes_on(text, kind, start, end, is_base)
        out.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": is_base, "votes": votes, "length": min(LENGTHS - 1, (end - start) // 4), "word": word})
    return out


_CANDIDATE = "kind int, start int, end int, base boolean, votes string, length int, word int"


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the candidates of every whole text; null counts as empty."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([rows.schema["id"], StructField("found", ArrayType(StructType.fromDDL(_CANDIDATE)))])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_candidates(text, base_spans(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(found, arrow.field(1).type)], schema=arrow)

    return rows.mapInArrow(find, schema)


@dataclass(frozen=True)
class SpanModel:
    """``prior``: the chance of personal data, by kind, of proposals and of base
    spans.  ``reliability``: by kind and labeler the chance of a yes, among its
    votes, on what is not personal data and on what is.  ``weights``: of the
    final classifier."""

    prior: np.ndarray
    reliability: np.ndarray
    weights: np.ndarray

    def posterior(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """What the votes alone say: the chance of personal data.  A failed
        test of validity is a proof, not a vote."""
        prior = self.prior[kind, (votes[:, 0] == YES).astype(int)]
        odds = np.log(prior) - np.log(1 - prior)
        for k in range(len(LABELERS)):
            on_true, on_false = self.reliability[kind, k, 1], self.reliability[kind, k, 0]
            odds = odds + np.where(votes[:, k] == YES, np.log(on_true / on_false), 0) + np.where(votes[:, k] == NO, np.log((1 - on_true) / (1 - on_false)), 0)
        return np.where(votes[:, 1] == NO, 0.0, 1 / (1 + np.exp(-odds)))

    def score(self, kind: np.ndarray, votes: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The final classifier's chance of personal data."""
        return 1 / (1 + np.exp(-self.weights[features(kind, votes, length, word)].sum(axis=1)))


_VOTED = len(KINDS) * len(LABELERS) * 3
_SIZE = len(KINDS) + _VOTED + len(KINDS) * LENGTHS + len(KINDS) * WORDS + 1


def features(kind: np.ndarray, votes: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The numbers of the features that a candidate has; what is not said (an
    abstention, no word) is the last, whose weight stays 0."""
    at = len(KINDS) + (kind[:, None] * len(LABELERS) + np.arange(len(LABELERS))) * 3 + votes
    at = np.where(votes == ABSTAINS, _SIZE - 1, at)
    by_length = len(KINDS) + _VOTED + kind * LENGTHS + length
    by_word = np.where(word > 0, len(KINDS) + _VOTED + len(KINDS) * LENGTHS + kind * WORDS + word, _SIZE - 1)
    return np.column_stack([kind, at, by_length, by_word])


def _estimate(kind: np.ndarray, votes: np.ndarray, n: np.ndarray) -> SpanModel:
    """Expectation-maximisation from the majority of the votes.  Abstentions
    say nothing, a failed test of validity settles it."""
    yes, no, base = votes == YES, votes == NO, votes[:, 0] == YES
    p = np.where(no[:, 1], 0.0, 1 / (1 + np.exp(-(yes.sum(axis=1) - no.sum(axis=1)).astype(float))))
    good, bad = PRIOR
    model = None
    for _ in range(ROUNDS):
        prior, rates = np.empty((len(KINDS), 2)), np.empty((len(KINDS), len(LABELERS), 2))
        for k in range(len(KINDS)):
            of = kind == k
            w = np.stack([n[of] * (1 - p[of]), n[of] * p[of]])
            for b in (0, 1):
                those = w[:, (base[of] == b) & ~no[of, 1]]  # the disproved are no matter of chance
                prior[k, b] = (those[1].sum() + DOUBT[b]) / (those.sum() + sum(DOUBT))
            said, denied = w @ yes[of], w @ no[of]
            rates[k] = ((said + np.array([[bad], [good]])) / (said + denied + good + bad)).T
        model = SpanModel(prior, rates, np.zeros(_SIZE))
        p = model.posterior(kind, votes)
    return model


def _fit(model: SpanModel, kind: np.ndarray, votes: np.ndarray, length: np.ndarray, word: np.ndarray, n: np.ndarray) -> SpanModel:
    """Logistic regression towards the posteriors.  The label model's opinion
    of every pattern of votes counts as EVERY of a candidate, so that no vote
    is unknown."""
    every = np.array(list(product((ABSTAINS, YES, NO), repeat=len(LABELERS))))
    kinds, patterns = np.repeat(np.arange(len(KINDS)), len(every)), np.tile(every, (len(KINDS), 1))
    target = np.concatenate([model.posterior(kind, votes), model.posterior(kinds, patterns)])
    bare = features(kinds, patterns, kinds, kinds)
    bare[:, -2:] = _SIZE - 1  # of no length and no word
    at = np.concatenate([features(kind, votes, length, word), bare])
    # Counts weigh by their root, so that rare patterns are heard.
    weight = np.concatenate([np.sqrt(n), np.full(len(kinds), EVERY)])
    w = np.zeros(_SIZE)
    for _ in range(STEPS):  # Newton's method; the ridge keeps every weight finite
        slope, bend = RIDGE * w, RIDGE * np.eye(_SIZE)
        for i in range(0, len(at), 4096):
            own = at[i : i + 4096]
            p = 1 / (1 + np.exp(-w[own].sum(axis=1)))
            x = np.zeros((len(own), _SIZE))
            np.add.at(x, (np.arange(len(own))[:, None], own), 1.0)
            x[:, -1] = 0
            slope += x.T @ ((p - target[i : i + 4096]) * weight[i : i + 4096])
            bend += (x * (p * (1 - p) * weight[i : i + 4096])[:, None]).T @ x
        w -= np.linalg.solve(bend, slope)
    return SpanModel(model.prior, model.reliability, w)


def learn(found: DataFrame) -> SpanModel:
    """The model of all candidates of :func:`candidates`."""
    counts = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.length", "c.word").count()
    rows = sorted(tuple(r) for r in counts.collect())  # see WORDS, LENGTHS
    kind, length, word, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 2, 3, 4))
    votes = np.array([[int(v) for v in r[1]] for r in rows], dtype=np.int64).reshape(len(rows), len(LABELERS))
    return _fit(_estimate(kind, votes, n), kind, votes, length, word, n)


def _chosen(found: list[dict], model: SpanModel) -> list[tuple[int, int, int]]:
    """Base spans, and the accepted ones, the likelier and longer first where
    they meet."""
    spans = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
    more = [c for c in found if not c["base"]]
    if more:
        kind, length, word = (np.array([c[k] for c in more]) for k in ("kind", "length", "word"))
        scores = model.score(kind, np.array([[int(v) for v in c["votes"]] for c in more]), length, word)
        taken: list[tuple[int, int]] = []
        for score, c in sorted(zip(scores, more, strict=True), key=lambda x: (-x[0], x[1]["start"] - x[1]["end"], x[1]["start"], x[1]["kind"])):
            k = bisect_right(taken, (c["end"] - 1, 1 << 62))
            if score >= 0.5 and not (k and taken[k - 1][1] > c["start"]):
                taken.insert(k, (c["start"], c["end"]))
                spans.append((c["kind"], c["start"], c["end"]))
    return sorted(spans)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df`` its id, n_email, n_ip, n_card and n_phone (base
    spans), base_sha256 (of the base spans as text) and spans: kind:start:end
    of all spans, by kind and start, joined with commas.

    Null and empty texts have no span; repeated rows and null ids have a row
    each; an empty table gives none; texts are read whole; other columns, of
    whatever name, play no part.  Spans that are not base ones never meet
    another span.
    """
    found = stored(candidates(df, id_col, text_col), "candidates")
    model = learn(found)
    ids = found.schema["id"]
    schema = StructType([ids, *StructType.fromDDL("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string").fields])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [[], [], [], []], [], []
            for row in batch.column(1).to_pylist():
                base = sorted((c["kind"], c["start"], c["end"]) for c in row if c["base"])
                for k in range(len(KINDS)):
                    counts[k].append(sum(b[0] == k for b in base))
                hashes.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(_chosen(row, model)))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(choose, schema).withColumnRenamed("id", id_col)


def redacted(text: str | None, spans: str) -> str | None:
    """A text with its spans (see :func:`find`) replaced by their kinds in
    brackets; where spans meet, the first and longest stands for all."""
    parts = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for start, end, kind in parts:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return None if text is None else "".join(out) + text[at:]
