"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

A text is a chain of tokens: letters, digits and characters beyond ASCII, with ``. - _ + /`` where they stand
between two of these. Every token is tagged O (no secret), B (a secret begins) or I (it goes on). A tag's
score is a sum of weights of the token's features:

* shape: length, kinds of characters, changes between kinds, share of vowels, first characters
* neighbours: the words before and after, their shapes, the signs between (``=``, ``:``, quotes, line ends)
* file: shares of tokens with digits and of long ones, and of line ends in the text

and of weights of neighbouring tags; I never follows O. The likeliest tags of a whole chain come from Viterbi's
algorithm, in blocks: each block gives a table from its first to its last tag, and the tables are chained.

The model learns from the patterns' own finds (distant supervision) in a bounded sample, ``train_rows``
rows drawn by a hash, of which ``train_windows`` windows with and as many without a find are kept. A find also
gives a window in which a random string of another alphabet stands in its place, and one without a secret in which words
around it do, joined like paths and names. Half of the windows hide the words and signs around, so that shape alone must
do; this is what finds secrets of other forms and names.

The patterns' spans always stay. Spans of the field are added where they touch none of these.

Nulls: a null text is empty; a null doc_id is kept. Rows are scanned one by one: repeated rows get equal answers,
spans of several kinds may overlap, an empty table gives no rows. Patterns run over a whole text however long it is; the
chain of a text of more than SECTION bytes ends at the last white space before each SECTION bytes, and a new one begins.
Other columns are not read. Without finds in the sample nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, mix, pieces_of, stored, texts, tidied
from .words import lower_ascii, words

#: bounds of what is learned from: rows of the sample, windows of each kind, tokens on each side of a window's middle
TRAIN_ROWS, TRAIN_WINDOWS, REACH = 50_000, 3_000, 8
#: bytes of a chain, tokens of a block of Viterbi's algorithm
SECTION, BLOCK = 4 << 20, 64

# fixed values: the patterns, in the order of kinds. A text's matches are taken from left to right; one that is too short is dropped.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_HEX_BYTE = np.isin(np.arange(256), list(b"0123456789abcdef"))


def pattern_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) in bytes, sorted."""
    low = text.lower()
    named = any(k in low for k in (b"pass", b"secret", b"token", b"api"))
    out = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_ASSIGN] if named else []
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # HEX's matches are the longest runs of its characters
    inside = np.r_[False, _HEX_BYTE[np.frombuffer(text, np.uint8)], False]
    limits = np.flatnonzero(inside[1:] != inside[:-1])
    for a, b in limits.reshape(-1, 2)[np.diff(limits)[::2] >= LEAST_HEX].tolist():
        out.append((a, 2, b, a))
    return sorted(out)


# kinds of bytes: 0 others, 1 small letters, 2 capitals, 3 digits, 4 beyond ASCII
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_JOINS = np.isin(np.arange(256), list(b".-_+/"))
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY")) | (np.arange(256) >= 128)
_SPACES = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
# signs between tokens: = : quotes line ends others
_SIGNS = np.zeros(256, np.uint8)
_SIGNS[33:128] = 16
_SIGNS[np.flatnonzero(_KIND | _SPACES)] = 0
_SIGNS[ord("=")], _SIGNS[ord(":")], _SIGNS[[34, 39, 96]], _SIGNS[[10, 13]] = 1, 2, 4, 8
_PART = _KIND > 0
_PART[1] = True  # joins are marked by 1

#: features and how many values each has; value 0 of those of the surroundings means hidden or none
_NAMES = 4096
SIZES = {"bias": 1, "length": 16, "kinds": 64, "changes": 128, "vowels": 128, "hex": 32, "head": _NAMES, "file": 512, "before": 65, "after": 65, "shape_before": 1025, "shape_after": 1025, "last": _NAMES, "last_but_one": _NAMES, "next": _NAMES, "assigned": _NAMES}
AROUND = ("before", "after", "shape_before", "shape_after", "last", "last_but_one", "next", "assigned")
_OFFSETS = dict(zip(SIZES, np.cumsum([0, *list(SIZES.values())[:-1]]).tolist(), strict=True))
N_WEIGHTS = sum(SIZES.values())
_FORBIDDEN = -1e4


@dataclass
class Tokens:
    chain: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # is it the first of its chain?
    x: np.ndarray  # number of the weight of each feature


def _moved(values: np.ndarray, by: int, chain: np.ndarray, none: int = 0) -> np.ndarray:
    """The value of the token ``by`` places before (or after, below 0) in the same chain."""
    out = np.full_like(values, none)
    n = len(values)
    if by > 0 and n > by:
        out[by:] = np.where(chain[by:] == chain[:-by], values[:-by], none)
    elif by < 0 and n > -by:
        out[:by] = np.where(chain[:by] == chain[-by:], values[-by:], none)
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    """Of chains end to end with n+1 limits."""
    marks = data.copy()
    marks[marks == 1] = 0
    part = _KIND[data] > 0
    if len(data) > 2:
        joins = np.r_[False, _JOINS[data[1:-1]] & part[:-2] & part[2:], False]
        edge = at[(at > 0) & (at < len(data))]
        joins[edge] = False
        joins[edge - 1] = False
        marks[joins] = 1
    w = words(marks, at, _PART, lower_ascii()[data])
    chain, start, end = w.doc, w.start, w.end
    n = len(start)
    if not n:
        return Tokens(chain, start, end, np.zeros(0, bool), np.zeros((0, len(SIZES)), np.int32))
    inside = _PART[marks]
    kind = np.where(inside, _KIND[data], 0)
    total = lambda flags: np.add.reduceat(flags, start, dtype=np.int32)  # noqa: E731  (flags are 0 between tokens)
    size = end - start
    low, capital, digit, beyond = (total(kind == k) for k in (1, 2, 3, 4))
    case = np.where(kind == 4, 0, kind)
    change = np.r_[False, (case[1:] != case[:-1]) & (case[1:] > 0) & (case[:-1] > 0) & ~((case[:-1] == 2) & (case[1:] == 1))]
    change[start] = False
    changes, vowels = total(change), total(_VOWEL[data] & inside)
    length = np.minimum(15, np.where(size < 8, size, 6 + np.log2(np.maximum(size, 2) / 2).astype(np.int64)))
    kinds = (low > 0) | (capital > 0) * 2 | (digit > 0) * 4 | (beyond > 0) * 8 | (size > low + capital + digit + beyond) * 16 | (capital > 1) * 32
    per = lambda k: np.minimum(7, (8 * k) // np.maximum(size, 1))
    hexes = total((_HEX_BYTE[data] | ((data >= 65) & (data <= 70))) & inside) == size
    shape = length * 64 + kinds
    signs = np.where(inside, 0, _SIGNS[data])
    first = np.r_[True, chain[1:] != chain[:-1]]
    gap = np.zeros(n, np.int64)
    if n > 1:
        gap[1:] = np.bitwise_or.reduceat(signs, end[:-1])[: n - 1]
    tail = np.bitwise_or.reduceat(np.r_[signs, np.uint8(0)], end)  # the last token's own gap
    before = np.where(first, 64, gap + 1)
    after = np.where(np.r_[first[1:], True], tail % 32 + 33, _moved(before, -1, chain))
    name = (w.hash >> np.uint64(40)).astype(np.int64) % (_NAMES - 1) + 1
    head = np.zeros(n, np.int64)
    for k in range(4):
        head = head * 257 + np.where(size > k, data[np.minimum(start + k, len(data) - 1)], 256)
    head = (mix(head.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % _NAMES
    last = _moved(name, 1, chain)
    # file features: of all tokens of the chain
    held = np.maximum(1, np.bincount(chain, minlength=len(at) - 1))
    share = lambda flags, steps: np.minimum(steps - 1, (np.bincount(chain, weights=flags, minlength=len(at) - 1) * 2 * steps / held).astype(np.int64))
    file = (share(digit > 0, 8) * 4 + share(size >= 20, 4)) * 4 + share((before - 1) & 8 > 0, 4)
    values = {
        "bias": np.zeros(n, np.int64), "length": length, "kinds": kinds, "changes": length * 8 + per(2 * changes), "vowels": length * 8 + per(2 * vowels), "hex": hexes * 16 + length, "head": head,
        "file": file[chain] * 4 + (size >= 16) * 2 + (changes > 1), "before": before, "after": after, "shape_before": _moved(shape + 1, 1, chain), "shape_after": _moved(shape + 1, -1, chain),
        "last": last, "last_but_one": _moved(name, 2, chain), "next": _moved(name, -1, chain), "assigned": np.where((before - 1) & 3 > 0, last, 0) * (before < 64),
    }
    x = np.empty((n, len(SIZES)), np.int32)
    for k, (f, v) in enumerate(values.items()):
        x[:, k] = v + _OFFSETS[f]
    return Tokens(chain, start, end, first, x)


@dataclass
class Field:
    """weights: of a feature's value for O, B and I; moves: from tag to tag."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 3), np.float32)
        for k in range(x.shape[1]):
            out += np.take(self.weights, x[:, k], axis=0)
        return out


NOTHING = Field(np.zeros((N_WEIGHTS, 3), np.float32), np.zeros((3, 3), np.float32))


def viterbi(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest tags of chains end to end; ``first`` marks where a chain begins. A chain doesn't begin with I."""
    n = len(scores)
    if not n:
        return np.zeros(0, np.int8)
    blocks = -(-n // BLOCK)
    e = np.zeros((blocks * BLOCK, 3), np.float32)
    e[:n] = scores
    e = np.ascontiguousarray(e.reshape(blocks, BLOCK, 3).transpose(1, 2, 0))  # (place, tag, block)
    new = np.ones(blocks * BLOCK, bool)  # what fills the last block is a chain of its own
    new[:n] = first
    new = np.ascontiguousarray(new.reshape(blocks, BLOCK).T)
    inner = np.array(moves, np.float32)[:, :, None]
    inner[0, 2] = _FORBIDDEN
    start = np.zeros((3, 3, 1), np.float32)
    start[:, 2] = _FORBIDDEN
    steps = [np.where(new[k], start, inner) if new[k].any() else inner for k in range(BLOCK)]  # (from, to, block)
    # best score from the tag before a block to each of its tags: (before, tag, block)
    best = np.repeat(np.where(np.eye(3) > 0, np.float32(0), np.float32(-np.inf))[:, :, None], blocks, 2)
    for k in range(BLOCK):
        ways = [best[:, t, None] + steps[k][None, t] for t in range(3)]
        best = np.maximum(np.maximum(ways[0], ways[1]), ways[2]) + e[k]
    into = np.empty((3, blocks), np.float32)
    state = np.array([0.0, -np.inf, -np.inf])
    for b, table in enumerate(best.transpose(2, 0, 1).astype(np.float64)):
        into[:, b] = state
        state = (state[:, None] + table).max(0)
        state -= state.max()
    # again from the known scores, with the tag before each
    back = np.empty((BLOCK, 3, blocks), np.int8)
    score = into
    for k in range(BLOCK):
        ways = score[:, None] + steps[k]
        back[k] = ways.argmax(0)
        score = ways.max(0) + e[k]
    leads = np.repeat(np.arange(3, dtype=np.int8)[:, None], blocks, 1)
    for k in range(BLOCK - 1, -1, -1):
        leads = np.take_along_axis(back[k], leads, 0)
    ends = np.empty(blocks, np.int64)
    tag = int(score[:, -1].argmax())
    for b in range(blocks - 1, -1, -1):
        ends[b] = tag
        tag = int(leads[tag, b])
    tags, at, column = np.empty((BLOCK, blocks), np.int8), ends, np.arange(blocks)
    for k in range(BLOCK - 1, -1, -1):
        tags[k] = at
        at = back[k][at, column].astype(np.int64)
    return tags.T.reshape(-1)[:n]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradient(scores: np.ndarray, tags: np.ndarray, there: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of windows, as (place, tag, window): minus the log-likelihood of the tags, and its derivatives by scores and moves.

    there: is the place within the window? Windows begin anywhere in a chain, so with any tag.
    """
    size, _, n = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[0] = scores[0]
    step = moves[:, :, None]
    for k in range(1, size):
        forward[k] = np.where(there[k], _log_sum(forward[k - 1][:, None] + step, 0) + scores[k], forward[k - 1])
    total = _log_sum(forward[-1], 0)
    for k in range(size - 2, -1, -1):
        backward[k] = np.where(there[k + 1], _log_sum(step + (scores[k + 1] + backward[k + 1])[None], 1), 0.0)
    of_scores = np.exp(forward + backward - total) * there[:, None]
    chosen = (np.arange(3)[None, :, None] == tags[:, None]) & there[:, None]
    of_scores -= chosen
    loss = float(total.sum() - scores[chosen].sum())
    of_moves = np.zeros((3, 3))
    for k in range(1, size):
        pair = np.exp(forward[k - 1][:, None] + step + (scores[k] + backward[k])[None] - total) * there[k]
        seen = np.bincount(tags[k - 1][there[k]] * 3 + tags[k][there[k]], minlength=9).reshape(3, 3)
        of_moves += pair.sum(2) - seen
        loss -= float((seen * moves).sum())
    return loss, of_scores, of_moves


def learn(x: np.ndarray, tags: np.ndarray, there: np.ndarray, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Likelihood with a penalty on large weights, raised by Adam's steps. x: (window, place, feature)."""
    flat, tags, there = x.reshape(-1, x.shape[-1]), tags.T, there.T
    w, moves = np.zeros((N_WEIGHTS, 3)), np.zeros((3, 3))
    moves[0, 2] = _FORBIDDEN
    mean, square = np.zeros(w.size + 9), np.zeros(w.size + 9)
    for k in range(1, rounds + 1):
        scores = sum(np.take(w, flat[:, f], axis=0) for f in range(flat.shape[1])).reshape(*x.shape[:2], 3)
        _, of_scores, of_moves = gradient(np.ascontiguousarray(scores.transpose(1, 2, 0)), tags, there, moves)
        of_scores = of_scores.transpose(2, 0, 1).reshape(-1, 3)
        g = np.stack([np.bincount(flat.ravel(), weights=np.repeat(of_scores[:, t], flat.shape[1]), minlength=N_WEIGHTS) for t in range(3)], 1)
        of_moves[0, 2] = 0.0
        pull = np.r_[w.ravel(), np.where(moves > _FORBIDDEN, moves, 0.0).ravel()]
        g = np.r_[g.ravel(), of_moves.ravel()] / len(x) + ridge * pull
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        w -= step[:-9].reshape(-1, 3)
        moves -= step[-9:].reshape(3, 3)
    return Field(w.astype(np.float32), moves.astype(np.float32))


def hidden(x: np.ndarray) -> np.ndarray:
    """Features without the words and signs around."""
    x = x.copy()
    for k, f in enumerate(SIZES):
        if f in AROUND:
            x[..., k] = _OFFSETS[f]
    return x


def _sections(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of chains: where a group begins in data, and its chains' limits from there. A long text is several chains."""
    limits: list[int] = [0]

    def group() -> tuple[int, np.ndarray]:
        return limits[0], np.array(limits) - limits[0]

    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - limits[0] > SECTION and len(limits) > 1:
            yield group()
            limits = [a]
        while b - a > SECTION:
            spaces = np.flatnonzero(_SPACES[data[a + 1 : a + SECTION]])
            end = a + 1 + int(spaces[-1]) if len(spaces) else a + SECTION
            while not len(spaces) and data[end] & 0xC0 == 0x80:
                end -= 1  # not within a character
            limits.append(end)
            yield group()
            a, limits = end, [end]
        limits.append(b)
    if len(limits) > 1:
        yield group()


def _found(field: Field, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in bytes of data, of what the field takes for secrets."""
    starts, ends = [], []
    for base, limits in _sections(data, at):
        t = tokens(data[base : base + limits[-1]], limits)
        tags = viterbi(field.scores(t.x), t.first, field.moves)
        begin = np.flatnonzero(tags == 1)
        stop = np.flatnonzero((tags > 0) & np.r_[tags[1:] != 2, True] if len(tags) else tags > 0)
        starts.append(t.start[begin] + base)
        ends.append(t.end[stop] + base)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, SECTION):
                data, at = encoded(piece.column(1))
                starts, ends = _found(field, data, at)
                edge = np.searchsorted(starts, at)
                rows = []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    text = data[a:b].tobytes()
                    spans = [x[:3] for x in pattern_spans(text)]
                    if edge[k] < edge[k + 1]:
                        spans = _added(spans, (starts[edge[k] : edge[k + 1]] - a).tolist(), (ends[edge[k] : edge[k + 1]] - a).tolist())
                    rows.append(_in_code_points(text, spans))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def _added(spans: list, starts: list[int], ends: list[int]) -> list:
    """Sorted spans with those of the field that overlap none of them."""
    out, at, reach = [], 0, 0
    for a, b in zip(starts, ends, strict=True):
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= a:
            out.append((a, 3, b))
    return sorted(spans + out)


def _in_code_points(text: bytes, spans: list) -> list[dict]:
    if not spans:
        return []
    limits = sorted({x for a, _, b in spans for x in (a, b)})
    place, at, n = {}, 0, 0
    for x in limits:
        n += len(text[at:x].decode())
        place[x], at = n, x
    return [{"kind": KINDS[k], "start": place[a], "end": place[b], "text": text[a:b].decode()} for a, k, b in spans]


def _random_secret(seed: int) -> bytes:
    """Of one of several alphabets, as long as keys mostly are."""
    r = np.random.default_rng(seed)
    small, capital, digit = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    alphabets = (small + capital + digit, small + capital + digit + b"+/", small + capital + digit + b"-_", capital + digit, small + digit, b"ABCDEF" + digit)
    signs = np.frombuffer(alphabets[r.integers(len(alphabets))], np.uint8)
    one = lambda: signs[r.integers(len(signs), size=r.integers(16, 49))].tobytes()
    return b".".join(one() for _ in range(3)) if r.random() < 0.15 else one()


def _plain_name(text: bytes, seed: int) -> bytes:
    """Words of the text joined as in paths, addresses and names."""
    r = np.random.default_rng(seed)
    found = re.findall(rb"[A-Za-z]+", text) or [b"x"]
    some = [found[k] for k in r.integers(len(found), size=r.integers(2, 7))]
    joins = [b"./-_+"[k : k + 1] for k in r.integers(5, size=2)]
    return b"".join(w + joins[int(r.integers(2))] for w in some) + str(int(r.integers(10000))).encode() * bool(r.random() < 0.3)


def _replaced(data: np.ndarray, a: int, b: int, low: int, high: int, file: int) -> Iterator[tuple[bool, bytes, bytes]]:
    """Windows with something else in place of data[a:b]. low and high: limits of the text, file: its file feature."""
    seed = zlib.crc32(data[a:b])
    left, right = data[max(low, a - 200) : a].tobytes(), data[b : min(high, b + 200)].tobytes()
    column = list(SIZES).index("file")
    for secret, put in ((True, _random_secret(seed)), (False, _plain_name(left + right, seed))):
        t = tokens(np.frombuffer(left + put + right, np.uint8), np.array([0, len(left) + len(put) + len(right)]))
        t.x[:, column] = file * 4 + (t.x[:, column] - _OFFSETS["file"]) % 4 + _OFFSETS["file"]
        i, j = int(np.searchsorted(t.end, len(left), "right")), int(np.searchsorted(t.start, len(left) + len(put), "left"))
        tags = np.zeros(len(t.start), np.int8)
        if secret:
            tags[i], tags[i + 1 : j] = 1, 2
        # the outermost tokens may be cut
        c, d = max(i - REACH, min(1, i)), min(i + REACH + 1, len(tags) - 1 if j < len(tags) else len(tags))
        yield secret, t.x[c:d].tobytes(), tags[c:d].tobytes()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and tags of the tokens around finds, and around as many other tokens: long ones, ones with digits and any."""
    for batch in batches:
        for piece in pieces_of(batch, SECTION):
            data, at = encoded(piece.column(0))
            secrets = np.array([(a + s, a + e) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for _, _, e, s in pattern_spans(data[a:b].tobytes())], np.int64).reshape(-1, 2)
            out: list[tuple] = []
            for base, limits in _sections(data, at):
                t = tokens(data[base : base + limits[-1]], limits)
                n = len(t.start)
                tags = np.zeros(n, np.int8)
                for a, b in secrets - base:
                    i, j = np.searchsorted(t.end, a, "right"), np.searchsorted(t.start, b, "left")
                    if i < j and tags[i] == 0:
                        tags[i], tags[i + 1 : j] = 1, 2
                        low, high = limits[t.chain[i]] + base, limits[t.chain[i] + 1] + base
                        file = int(t.x[i, list(SIZES).index("file")] - _OFFSETS["file"]) // 4
                        out += _replaced(data, a + base, b + base, low, high, file)
                if not n:
                    continue
                place = np.arange(n)
                lot = mix(place.astype(np.uint64) + np.uint64(n))
                clean = np.convolve(tags > 0, np.ones(2 * REACH + 1), "full")[REACH:-REACH] == 0
                odd = (t.end - t.start >= 12) | (np.isin(t.x[:, 2] - _OFFSETS["kinds"] & 4, [4]))
                centres = [(1, place[tags == 1]), (0, place[clean & odd][np.argsort(lot[clean & odd])[:200]]), (0, place[clean][np.argsort(lot[clean])[:50]])]
                for positive, middle in centres:
                    for c in middle.tolist():
                        a, b = max(c - REACH, int(np.searchsorted(t.chain, t.chain[c], "left"))), min(c + REACH + 1, int(np.searchsorted(t.chain, t.chain[c], "right")))
                        out.append((bool(positive), t.x[a:b].tobytes(), tags[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["positive", "x", "tags"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_windows: int = TRAIN_WINDOWS) -> Field:
    """docs: doc_id and text."""
    share = min(1.0, train_rows / max(1, docs.count()))
    lot = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30))
    rows = stored(docs.where(lot < int(share * (1 << 30))).select("text").mapInArrow(tidied(_windows), "positive boolean, x binary, tags binary"), "windows")
    rows = rows.dropDuplicates(["positive", "x"])
    got = [r for flag in (True, False) for r in rows.where(F.col("positive") == flag).orderBy(F.xxhash64("x"), "x").limit(train_windows).collect()]
    if not any(r.positive for r in got):
        return NOTHING
    size, n = 2 * REACH + 1, len(got)
    x, tags, there = np.zeros((n, size, len(SIZES)), np.int32), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for k, r in enumerate(got):
        t = np.frombuffer(r.tags, np.int8)
        x[k, : len(t)], tags[k, : len(t)], there[k, : len(t)] = np.frombuffer(r.x, np.int32).reshape(len(t), -1), t, True
    x[1::2] = hidden(x[1::2])
    return learn(x, tags, there)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, text) of every row, by start and then kind."""
    d = texts(docs)
    return d.mapInArrow(tidied(_scan(fit(d) if field is None else field)), "doc_id long, spans array<struct<kind: string, start: long, end: long, text: string>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return scan(docs).select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
