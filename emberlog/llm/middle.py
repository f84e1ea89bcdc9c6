"""Fill-in-middle: texts are cut in three and put together so that the middle comes last. SQL functions only.

A text is a row of units: a word with the white space before it, or white space at the
end. Two numbers from a hash of the document's id cut the units into prefix, middle and
suffix; a third decides whether the text is rearranged at all, a fourth the arrangement:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is; also where it is empty or holds a mark itself

restore() rebuilds the text from form and output alone. A mark can't begin inside a part and
end inside the mark after it, so the first one found is the one that was set.

Nulls: a null text is empty; a null doc_id is hashed as an empty one. Rows are worked
on one by one: repeated rows get equal answers, ties don't occur, an empty table gives no rows. Long texts are
one row like any other: their units are one array of the task, and matching never goes back over them.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: fixed values: marks, and the units of a text. Possessive, since a unit's two kinds of characters have none in common.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++|[\\x20\\x09-\\x0D]++"


def _number(digest: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, unsigned."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output.

    ``rate``: percent of documents to be rearranged; ``spm_rate``: percent of these with the suffix first.
    """
    d = texts(docs, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256).alias("digest"))
    d = d.withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)))
    d = d.withColumn("n", F.size("units").cast("long"))
    d = d.withColumns({"c1": _number("digest", 0) % (F.col("n") + 1), "c2": _number("digest", 1) % (F.col("n") + 1)})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_number("digest", 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number("digest", 3) % 100 < spm_rate, "spm").otherwise("psm")
    d = d.withColumns({"a": F.least("c1", "c2").cast("int"), "b": F.greatest("c1", "c2").cast("int"), "form": form})

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))

    d = d.withColumns({"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b") - F.col("a")), "suffix": part(F.col("b"), F.size("units") - F.col("b"))})
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(formed: DataFrame) -> DataFrame:
    """formed (form, output) with ``restored``: the text that output was made of."""
    last = F.when(F.col("form") == "psm", SUFFIX).otherwise(PREFIX)
    d = formed.withColumn("_inside", F.when(F.col("form") != "plain", F.substr("output", F.lit(len(PREFIX) + 1))))
    d = d.withColumn("_first", F.when(F.col("form") == "psm", F.substring_index("_inside", SUFFIX, 1)).otherwise(F.substring_index("_inside", PREFIX, 1)))
    d = d.withColumn("_rest", F.substr("_inside", F.length("_first") + F.length(last) + 1))
    d = d.withColumn("_second", F.substring_index("_rest", MIDDLE, 1))
    d = d.withColumn("_middle", F.substr("_rest", F.length("_second") + len(MIDDLE) + 1))
    whole = F.when(F.col("form") == "psm", F.concat("_first", "_middle", "_second")).when(F.col("form") == "spm", F.concat("_second", "_middle", "_first")).otherwise(F.col("output"))
    return d.select(*formed.columns, whole.alias("restored"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    d = restore(transform(docs).select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), "output"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p
"""
