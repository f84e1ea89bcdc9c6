"""Document fingerprints by winnowing, in SQL functions only.

Tokens are code points at every length. A k-gram's hash is its rolling (Karp-Rabin) value: the k code points as the
digits of a number to the base ``BASE`` modulo the prime ``PRIME``, so that h[i + 1] is h[i] less its first digit, times
the base, plus the next code point. Here a gram's value comes from those of its three groups of four code points,
which is the same number. A k-gram's packed value has the hash, spread over 32 bits, above and, below it, the
position counted backwards; so the smallest value of a window of ``W`` k-grams is the smallest hash and,
among equal ones, the rightmost. A fingerprint is the windows' minima with positions (code points from the start).
Texts that share ``K + W - 1`` code points in a row share a selected k-gram. A text of fewer
than ``K`` code points is one k-gram; one of fewer than ``W`` k-grams is one window.

Texts are dealt into rows of ``BLOCK`` windows, which overlap by the code points that their last windows reach. A block's
code points, grams and windows are columns, so Spark compiles the arithmetic; array functions with lambdas, which it
interprets, see blocks and selected grams only.

The likeness of two fingerprints is the Jaccard similarity of their hashes. Windows of an edited text that lie in what
is left of its original have the same minima, so only the rest is hashed again.

The next document is found in buckets of neighbouring doc_ids. Their limits are quantiles of a bounded sample (``PER_BUCKET`` ids a
bucket, ``MOST_BUCKETS`` buckets at most) and only part the work: every row is dealt by them, whatever the ids' distribution. The first document of a bucket
is also put at the end of the bucket before it, so texts are shuffled once.

Nulls: a null text is empty; null ids come last. Repeated ids stand in the order of a hash of their texts. With
one document the next one is itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id, row_key, shuffle_partitions, texts

K, W = 12, 16
# with blocks of this size a step has over 100 columns, so Spark compiles it by itself, in many small methods; fewer columns would make one method of all steps, too large to compile
BLOCK, REACH = 96, K + W - 2
BASE, PRIME, SPREAD = 1_540_483_477, (1 << 31) - 1, 2_654_435_769
_LAST = (1 << 31) - 1
MOST_BUCKETS, PER_BUCKET = 1 << 13, 20


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def blocks(text: Column, kind: int, start: Column) -> Column:
    """kind, the text's first window counted from ``start`` and the code points of every block of windows, whose number is 1 at least."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{0,{BLOCK + REACH}}})).{{1,{BLOCK}}}"), 1)
    held = F.when(F.length(text) > BLOCK + REACH, F.slice(found, 1, F.ceil((F.length(text) - REACH) / BLOCK).cast("int"))).otherwise(F.array(text))
    return F.transform(held, lambda part, k: F.struct(F.lit(kind).alias("kind"), (start + k * BLOCK).cast("long").alias("at"), part.alias("part")))


def window_minima(d: DataFrame) -> DataFrame:
    """d with ``least``, the smallest packed value of every window of its block ``part``, which begins at code point ``at``.

    Every step is a projection of its own, whose columns the next ones use several times.
    """
    d = d.withColumn("size", F.length("part"))
    kept = d.columns
    for step in _steps():
        d = d.selectExpr(*kept, *step)
        kept = [c for c in kept if c != "part"]
    return d


def _steps() -> list[list[str]]:
    n = BLOCK + REACH  # code points; grams and windows are fewer by what they reach
    power = [pow(BASE, i, PRIME) for i in range(K + 1)]
    # a text of fewer than K code points is read as if zeros followed, which are divided out
    back = ", ".join(f"{pow(power[K - i], -1, PRIME)}L" for i in range(K))
    short = f"CASE WHEN size < {K} THEN {{0}} * get(array({back}), size) % {PRIME}L ELSE {{0}} END"
    gram = "(h{0} * {3}L + h{1} * {4}L + h{2}) % {5}L"

    def packed(i: int) -> str:
        h = gram.format(i, i + 4, i + 8, power[8], power[4], PRIME)
        v = f"shiftleft(shiftright(({short.format('(' + h + ')') if i == 0 else h}) * {SPREAD}L, 31), 31) + ({_LAST - i}L - at)"
        # grams of the first window that a short text hasn't
        return f"CASE WHEN size >= {i + K} THEN {v} ELSE {(1 << 63) - 1}L END" if 0 < i < W else v

    return [
        ["split(part, '') AS points"],
        [f"coalesce(cast(ascii(get(points, {i})) AS bigint), 0L) AS c{i}" for i in range(n)],
        [f"(c{i} * {power[3]}L + c{i + 1} * {power[2]}L + c{i + 2} * {power[1]}L + c{i + 3}) % {PRIME}L AS h{i}" for i in range(n - 3)],
        [f"{packed(i)} AS v{i}" for i in range(n - K + 1)],
        [f"least(v{i}, v{i + 1}, v{i + 2}, v{i + 3}) AS v{i}" for i in range(n - K - 2)],
        [f"slice(array({', '.join(f'least(v{i}, v{i + 4}, v{i + 8}, v{i + 12})' for i in range(BLOCK))}), 1, greatest(least(size, {n}) - {REACH}, 1)) AS least"],
    ]


def joined(parts: Column) -> Column:
    """Packed values of a text, by position, from those of its blocks."""
    return F.array_distinct(F.flatten(F.transform(F.sort_array(parts), lambda x: x.picked)))


def as_text(values: Column) -> Column:
    """Hexadecimal packed values; ``hash`` and ``position`` of one are v >> 31 and 2**31 - 1 - (v & (2**31 - 1))."""
    return F.array_join(F.transform(values, lambda v: F.hex(v)), " ")


def hashes(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct hashes."""
    return _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def bucketed(d: DataFrame) -> DataFrame:
    """d (id, uid and more) with ``bucket``: runs of neighbours in the order of id and uid, of like size."""
    n = min(MOST_BUCKETS, max(16 * shuffle_partitions(d.sparkSession), d.count() // 5000))
    # the sample: the first by a hash; its size is bounded by the number of buckets
    seen = sorted((r.id, r.uid) for r in d.select("id", "uid").distinct().orderBy(F.xxhash64("id", "uid"), "id", "uid").limit(PER_BUCKET * n).collect())
    limits = [seen[k * len(seen) // n] for k in range(1, n)] if len(seen) >= n else seen[1:]
    if not limits:
        return d.withColumn("bucket", F.lit(0))
    ids, uids = (F.array(*[_long(x[k]) for x in limits]) for k in (0, 1))
    steps = [1 << k for k in range(len(limits).bit_length() - 1, -1, -1)]

    def up(at: Column, step: Column) -> Column:
        """Binary search: how many limits the row has reached."""
        i = F.get(ids, at + step - 1)
        reached = (F.col("id") > i) | ((F.col("id") == i) & (F.col("uid") >= F.get(uids, at + step - 1)))
        return at + F.when(F.coalesce(reached, F.lit(False)), step).otherwise(0)

    return d.withColumn("bucket", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), up))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many of the next document's.
    """
    d = bucketed(texts(docs).select("doc_id", order_id().alias("id"), row_key().alias("uid"), "text"))
    firsts = d.groupBy("bucket").agg(F.min(F.struct("id", "uid")).alias("first"))
    by = Window.orderBy("bucket")
    # a row per bucket: MOST_BUCKETS bounds what is sent to one task and broadcast
    over = F.last("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select(F.col("first.id").alias("id"), F.col("first.uid").alias("uid"), "bucket", F.coalesce(F.lag("bucket").over(by), over).alias("before"))
    ghosts = d.join(F.broadcast(firsts), ["id", "uid", "bucket"]).dropDuplicates(["bucket"]).select("doc_id", "id", "uid", "text", F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    both = d.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "uid")
    both = both.withColumns({"place": F.row_number().over(order), "next": F.lead("text", 1, "").over(order)})
    both = both.withColumn("n_chars", F.length("text")).withColumn("moved", F.floor(F.col("n_chars") / 4).cast("int"))
    # windows that an edit at the end leaves as they are; 0: the edited text is read whole
    both = both.withColumn("whole", F.greatest(F.col("n_chars") - F.col("moved") - REACH, F.lit(0)))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("moved")), F.substring("next", F.lit(1), F.col("moved"))))
    row = F.struct("doc_id", "ghost", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = both.withColumns({"row": row, "rest": F.substring("edited", F.col("whole") + 1, F.length("edited"))})
    parts = F.concat(blocks(F.col("text"), 0, F.lit(0)), blocks(F.col("rest"), 1, F.col("whole")))
    both = both.select("bucket", "place", "row", "whole", F.explode(parts).alias("b")).select("bucket", "place", "row", "whole", "b.kind", "b.at", "b.part")
    own, first = F.col("kind") == 0, (F.col("kind") == 0) & (F.col("at") == 0)
    both = window_minima(both.withColumns({"row": F.when(first, F.col("row")), "stay": F.when(own, F.col("whole") - F.col("at"))}).drop("whole"))
    found = F.struct("at", F.array_distinct("least").alias("picked"))
    # the last of the windows that stay
    last = F.when(F.col("stay").between(1, BLOCK), F.get("least", F.col("stay").cast("int") - 1))
    both = both.select("bucket", "place", "row", last.alias("last"), F.when(own, found).alias("own"), F.when(~own, found).alias("rest"))
    # blocks of a text lie in one task already
    both = both.groupBy("bucket", "place").agg(F.first("row", True).alias("row"), F.max("last").alias("last"), F.collect_list("own").alias("own"), F.collect_list("rest").alias("rest"))
    both = both.select("bucket", "place", "row.*", "last", joined(F.col("own")).alias("picked"), joined(F.col("rest")).alias("rest"))
    head = F.slice("picked", 1, F.coalesce(F.array_position("picked", F.col("last")), F.lit(0)).cast("int"))
    both = both.withColumns({"h": hashes(F.col("picked")), "edited_picked": F.array_distinct(F.concat(head, "rest"))})
    both = both.withColumn("h_next", F.lead("h").over(Window.partitionBy("bucket").orderBy("place"))).where("not ghost")
    both = both.withColumn("h_edited", hashes(F.col("edited_picked")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("picked")).alias("fingerprint"),
        as_text(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("h_edited")).alias("near_edited"),
        likeness(F.col("h"), F.col("h_next")).alias("near_next"),
    )


def _oracle() -> str:
    # every step is a table of its own, so that no expression is repeated
    steps = ", ".join(f"g{j} AS (SELECT * EXCLUDE (h), coalesce((h * {BASE} + lead(c, {j}) OVER (PARTITION BY doc_id, kind ORDER BY i)) % {PRIME}, h) AS h FROM g{j - 1})" for j in range(1, K))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, substring(t, 1, length(t) - length(t) // 4) || substring(nxt, 1, length(t) // 4) AS edited, lead(doc_id) OVER (ORDER BY doc_id) AS next_id, min(doc_id) OVER () AS first_id FROM d),
b AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
u AS (SELECT doc_id, kind, length(t) AS n, unnest(range(greatest(length(t), 1))) AS i, unnest(CASE WHEN t = '' THEN [''] ELSE string_split(t, '') END) AS x FROM b),
g0 AS (SELECT doc_id, kind, n, i, CASE WHEN n > 0 THEN unicode(x)::BIGINT END AS c, CASE WHEN n > 0 THEN unicode(x)::BIGINT ELSE 0 END AS h FROM u),
{steps},
p AS (SELECT doc_id, kind, i, greatest(n - {K - 1}, 1) AS grams, (((h * {SPREAD}) >> 31) << 31) + ({_LAST} - i) AS v FROM g{K - 1} WHERE i < greatest(n - {K - 1}, 1)),
m AS (SELECT doc_id, kind, i, grams, min(v) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS v FROM p),
s AS (SELECT DISTINCT doc_id, kind, v FROM m WHERE i < greatest(grams - {W - 1}, 1)),
f AS (SELECT doc_id, kind, string_agg(hex(v), ' ' ORDER BY v & {_LAST} DESC) AS shown, list(DISTINCT v >> 31) AS hs FROM s GROUP BY ALL)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.shown AS fingerprint, b.shown AS edited_fingerprint,
  len(list_intersect(a.hs, b.hs)) / (len(a.hs) + len(b.hs) - len(list_intersect(a.hs, b.hs))) AS near_edited,
  len(list_intersect(a.hs, c.hs)) / (len(a.hs) + len(c.hs) - len(list_intersect(a.hs, c.hs))) AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f c ON c.doc_id = coalesce(e.next_id, e.first_id) AND c.kind = 0
"""


#: DuckDB: the same rows as fingerprints() where ids are unique and not null.
ORACLE = _oracle()
