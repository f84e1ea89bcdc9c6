"""Toxicity: text is deobfuscated by a noisy-channel Viterbi decoder, then scored.

1. A character trigram model is counted over the words of all documents. Characters beyond the alphabets
   up to ``ALPHABETS`` count by classes, so that every one is counted and the model's size is set by alphabets, not by rows.
2. Tokens that look disguised (look-alike digits and signs or separators inside a word,
   letters said three times or more, runs of single letters) are decoded: a lattice holds, for every
   character, the letters that it may stand for, that it is a separator, or that it
   repeats the letter before. Viterbi finds the best path under the model and the
   channel's costs, in one pass with back-pointers. Stretches of scripts without spaces are read as pairs of characters.
3. The restored words and their beginnings are features. Labels give each feature a
   log-odds weight, less its own uncertainty, so that rare features weigh nothing.
   A logistic curve over a document's strongest and summed weights is its score.

Labels are learned only from rows with crc32(doc_id as text) mod 5 other than 0, and of
these from the ``train_rows`` first by a hash of doc_id (documented bound); all features of these rows are
counted, and those with a weight above zero are kept. Nothing but the text is an input of a score.

Nulls: a null or empty text gets the score of a text without evidence. A null doc_id is
scored and counts as not held out. Of several labels of one doc_id the toxic one holds; a label is used once per matching document;
null labels are not used. Without labels of both kinds the score is 0 everywhere. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, positional, stored, texts, tidied

TRAIN_ROWS = 200_000
#: words of more letters are features by a hash and aren't cached
LONG = 64
#: code points below are letters of their own in the model, others fall into CLASSES classes
ALPHABETS, CLASSES = 0x530, 64

# fixed values: what a sign may stand for
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c"}
SEPARATORS = set(".-_*~^'`,:;/\\#%&=\"\u200b\u200c\u200d\u00ad")
# fixed values: costs of the channel, natural logarithms
AS_IS, LOOKALIKE, SEPARATOR, REPEAT, SIGN = -0.05, -1.5, -0.7, -2.5, -10.0

_EDGES = " \t\r\n.,;:!?\"'()[]{}<>*%&#$-_=/\\|~^`+@«»„“”¿¡…"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SIGN = re.compile(r"[\d@$!|+(<€£¢.\-_*~^'`,:;/\\#%&=​‌‍­]")
_BESIDE = re.compile(r"\d[^\W\d_]|[^\W\d_]\d|[@$!][^\W\d_]")
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]{2,}")
#: white space other than the space
_BLANKS = r"[\t\r\n\x0b\x0c\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTER = re.compile(r"[^\W\d_]")


def disguised(token: str) -> bool:
    """A letter thrice, a digit or sign beside a letter, or one with letters on both sides."""
    first = _LETTER.search(token)
    if not first:
        return False
    last = len(token) - 1
    while not _LETTER.match(token, last):
        last -= 1
    return bool(_SIGN.search(token, first.end(), last) or _BESIDE.search(token) or _TRIPLE.search(token))


def folded(point: int) -> int:
    """A code point as the model counts it; numpy arrays are folded in _count_grams()."""
    return point if point < ALPHABETS else 0xE000 + point % CLASSES


class CharModel:
    """Trigrams of letters with word limits; unseen ones fall back to letter frequencies."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, one = Counter(), Counter(), Counter()
        for gram, n in counts.items():
            self.three[gram] += n
            self.two[gram[:2]] += n
            one[gram[2]] += n
        total = sum(one.values())
        self.one = {c: math.log((n + 1) / (total + 64)) for c, n in one.items()}
        self.least = math.log(1 / (total + 64))
        self.known: dict[str, float] = {}

    def log_p(self, gram: str) -> float:
        got = self.known.get(gram)
        if got is None:
            given = gram
            if not gram.isascii():
                gram = "".join(chr(folded(ord(c))) for c in gram)
            back = math.exp(self.one.get(gram[2], self.least))
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[given] = math.log((self.three.get(gram, 0) + 2 * back) / (self.two.get(gram[:2], 0) + 2))
        return got


@lru_cache(maxsize=1 << 16)
def arcs(c: str) -> tuple[tuple[str, float], ...]:
    """The letters that a character may stand for ('': none), and their costs."""
    if _LETTER.match(c):
        return ((c, AS_IS),)
    return (*((x, LOOKALIKE) for x in LOOKS.get(c, "")), ("", SEPARATOR if c in SEPARATORS else SIGN))


def decode(token: str, model: CharModel) -> str:
    """The likeliest plain word behind a token."""
    # a state is the last two letters; the best score of a path to it, and the path's last letter with what comes before
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    before, known = "", model.known
    for c in token:
        new: dict[str, tuple[float, tuple | None]] = {}
        ways, again = arcs(c), c == before and c in LOOKS
        for state, (score, path) in states.items():
            for x, cost in ways:
                if x:
                    gram = state + x
                    p = known.get(gram)
                    s, to = score + cost + (model.log_p(gram) if p is None else p), gram[1:]
                    if to not in new or new[to][0] < s:
                        new[to] = (s, (path, x))
                elif state not in new or new[state][0] < score + cost:
                    new[state] = (score + cost, path)
            # the character may repeat the letter that was said last
            if state[1] == c or (again and state[1] in LOOKS[c]):
                s = score + REPEAT / 2
                if state not in new or new[state][0] < s:
                    new[state] = (s, path)
        states, before = new, c
    _, path = max(((score + model.log_p(state + "$"), path) for state, (score, path) in states.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def tokens(text: str) -> list[str]:
    """Lower-case words without signs around them; runs of single letters also as one word."""
    out, run = [], []
    for raw in text.lower().split():
        t = raw.strip(_EDGES)
        if len(raw) <= 2 and len(t or raw) == 1:
            run.append(t or raw)
            continue
        if len(run) > 2:
            out.append(" ".join(run))
        run = []
        if t and not t.isascii() and _UNSPACED.search(t):
            parts = _UNSPACED.findall(t)
            out += [x[k : k + 2] for x in parts for k in range(len(x) - 1)]
            out += [y for x in _UNSPACED.split(t) if (y := x.strip(_EDGES))]
        elif t:
            # signs at the limits may be letters in disguise
            out.append(raw if raw != t and raw[0] in "@$!(<|+" and len(t) > 2 else t)
    if len(run) > 2:
        out.append(" ".join(run))
    return out


def restored(token: str, model: CharModel) -> str:
    if " " in token:
        return decode(token.replace(" ", ""), model)
    return decode(token, model) if disguised(token) else token


def features(word: str) -> list[str]:
    whole = "=" + word if len(word) <= LONG else f"=#{blake2b(word.encode(errors='replace'), digest_size=12).hexdigest()}"
    return [whole, *("^" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces_of(batch, 4 << 20):
            low = pc.replace_substring_regex(pc.utf8_lower(part.column(0)), _BLANKS, " ")
            words = pc.utf8_trim(pc.split_pattern(low, " ").flatten(), characters=_EDGES).value_counts()
            names, n = words.field("values"), words.field("counts").to_numpy(zero_copy_only=False)
            plain = pc.match_substring_regex(names, r"^\pL+$").to_numpy(zero_copy_only=False)
            names, n = names.filter(pa.array(plain)), n[plain]
            # code points of all words end to end; a trigram is three of them in one number
            points = np.frombuffer("".join(f"^^{w}$" for w in names.to_numpy(zero_copy_only=False).tolist()).encode("utf-32-le"), "<u4").astype(np.int64)
            points = np.where(points < ALPHABETS, points, 0xE000 + points % CLASSES)
            size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 3
            word = np.repeat(np.arange(len(size)), size)
            inside = np.flatnonzero(word[2:] == word[:-2])
            code = points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2]
            kinds, back = np.unique(code, return_inverse=True)
            total = np.bincount(back, weights=n[word[inside]].astype(float), minlength=len(kinds)).astype(np.int64)
            grams = ["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in kinds.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total, pa.int64())], names=["gram", "n"])


def char_model(docs: DataFrame) -> CharModel:
    """Counted over all texts, with all trigrams: a number set by alphabets, not by rows."""
    grams = docs.select("text").mapInArrow(tidied(_count_grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r.gram: r.n for r in grams.collect()})


def _document_features(model: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        pos, neg = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[x] for x in names], pa.int64()), pa.array([neg[x] for x in names], pa.int64())], names=["feature", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for t in set(tokens(text)):
                    got = known.get(t)
                    if got is None:
                        got = features(restored(t, model))
                        if len(t) <= LONG:
                            known[t] = got
                    found.update(got)
                (pos if toxic else neg).update(found)
            if len(known) > 200_000:
                known.clear()
            if len(pos) + len(neg) > 300_000:
                yield counted()
                pos, neg = Counter(), Counter()
        yield counted()

    return run


class Scorer:
    """Weights of features and the curve; score() needs nothing but the text."""

    def __init__(self, model: CharModel, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self.curve = (-30.0, 0.0, 0.0, 0.0)
        self.known: dict[str, float] = {}

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The strongest weight, the sum over distinct words, and that sum for the text's length."""
        total = best = 0.0
        words = set(tokens(text))
        for t in words:
            w = self.known.get(t)
            if w is None:
                w = max(map(self.weights.get, features(restored(t, self.model)), [0.0] * 9))
                if len(t) <= LONG:
                    self.known[t] = w
            if w:
                total += w
                best = max(best, w)
        if len(self.known) > 300_000:
            self.known.clear()
        return best, math.log1p(total), math.log1p(20 * total / (20 + len(words)))

    def score(self, text: str) -> float:
        x = sum(a * b for a, b in zip(self.curve, (1.0, *self.evidence(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def log_odds(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Lower limits of smoothed log-odds; 0 or less where the sign isn't certain."""
    a, b = pos + 0.5, neg + 0.5 * n_neg / max(1, n_pos)
    value = F.log(a / (n_pos + 1)) - F.log(b / (n_neg + 1))
    return value - 2.0 * F.sqrt(1 / a + 1 / F.greatest(b, F.lit(1.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a small penalty."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """docs: doc_id and text. labels: doc_id and toxic."""
    docs = docs.select("doc_id", "text")
    model = char_model(docs)
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(remainder() != 0)
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = stored(docs.join(wanted, "doc_id").select("text", "toxic"), "toxicity-train")
    n = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(True, 0), n.get(False, 0)
    scorer = Scorer(model, {})
    if not n_pos or not n_neg:
        return scorer
    counted = rows.repartition(max(1, min(64, (n_pos + n_neg) // 500))).mapInArrow(tidied(_document_features(model)), "feature string, pos long, neg long")
    counted = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weighed = counted.select("feature", log_odds(F.col("pos"), F.col("neg"), n_pos, n_neg).alias("weight")).where("weight > 0")
    # features of the bounded training rows whose sign is certain
    scorer.weights = {r.feature: r.weight for r in weighed.collect()}
    seen = rows.mapInArrow(tidied(_scores(scorer, raw=True)), "toxic int, a double, b double, c double").collect()
    scorer.curve = logistic(np.array([r[1:] for r in seen]), np.array([float(r.toxic) for r in seen]))
    return scorer


def _scores(scorer: Scorer, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 4 << 20):
                at = part.schema.get_field_index("text")
                others = [(n, c) for k, (n, c) in enumerate(zip(part.schema.names, part.columns, strict=True)) if k != at]
                text = part.column(at).to_pylist()
                if raw:
                    found = [scorer.evidence(t) for t in text]
                    made = [(n, pa.array([f[k] for f in found], pa.float64())) for k, n in enumerate("abc")]
                else:
                    made = [("score", pa.array([scorer.score(t) for t in text], pa.float64()))]
                yield pa.RecordBatch.from_arrays([c for _, c in others + made], names=[n for n, _ in others + made])

    return run


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    d = texts(docs)
    scorer = fit(d, labels, train_rows)
    return d.mapInArrow(tidied(_scores(scorer, raw=False)), "doc_id long, score double").select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the documents that score 0.5 or more."""
    scorer = fit(texts(docs), labels, train_rows)
    frame, others = positional(docs)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "text")
    out = frame.mapInArrow(tidied(_scores(scorer, raw=False)), kinds + ", score double").where("score < 0.5")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("given"), **{c: F.col(f"c{k}") for k, c in enumerate(others)}}
    return out.select(*[columns[c].alias(c) for c in docs.columns])
