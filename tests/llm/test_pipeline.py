"""Every stage of the pipeline on its own input against plain Python, and the whole of it against the stages one after the other."""

import random
import zlib

import numpy as np

from emberlog.llm import packing, toxicity
from tests.llm.fixtures import PASSAGE, prose
from tests.llm.test_dedup import brute_groups, brute_lines
from tests.llm.test_others import brute_leaks, reference_ids

ITEMS = [(1, prose(40, 900) + " 12 apples."), (2, "How many " + prose(20, 901) + " are 7 and 8?"), (3, None)]


def corpus():
    rng, rows, labels = random.Random(3), [], []
    for i in range(160):
        words = prose(rng.randrange(20, 60), i + 10).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum", "trash"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    lined = "\n".join(f"line {k} {prose(5, k)}" for k in range(12))
    rows += [(200, lined), (201, "first\n" + "\n".join(lined.split("\n")[2:8]) + "\nlast"), (202, lined), (203, PASSAGE), (204, PASSAGE + " more"), (205, None), (206, ""), (207, "a\nb"), (208, prose(30, 70) + " " + ITEMS[0][1]), (209, ITEMS[1][1].replace("7", "9")), (210, "you m.o.r.o.n and scum and 1d10t trash"), (211, "long " + prose(9000, 71))]
    return rows, labels


def texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_stages_against_plain_python(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = corpus()
    sf = str(tmp_path)
    n = lambda t: None if t is None else len(t)
    spark.createDataFrame([(i, t, "en", "s", n(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages, docs, before = dict(p.STAGES), p.table(spark, sf, "documents"), rows

    # each document scored on its own by the fitted model
    scorer = toxicity.fit(docs.fillna("", ["text"]), p.table(spark, sf, "labels"))
    want = [(i, t) for i, t in before if scorer.score(t or "") < 0.5]
    docs = p.stored(stages["toxicity"](spark, docs, sf), "t")
    assert texts(docs) == want and 30 < len(before) - len(want) < 50 and 210 not in dict(want)

    before, after = want, brute_lines(want)
    want = [(i, t if t is None else after[(i, t)][2]) for i, t in before if not (after[(i, t or "")][1] and not after[(i, t or "")][2].strip())]
    docs = p.stored(stages["line_dedup"](spark, docs, sf), "l")
    assert texts(docs) == want and 202 not in dict(want) and dict(want)[201] == "first\nlast"
    assert all(r.n_chars == n(r.text) for r in docs.collect())

    before = want
    want = [(i, t) for (i, t) in before if next(g for d, _, g in brute_groups(before, 5, 80) if d == i) == i]
    docs = p.stored(stages["minhash_near_dedup"](spark, docs, sf), "m")
    assert texts(docs) == want and 203 in dict(want) and 204 not in dict(want)

    before = want
    leaks = brute_leaks([(i, t or "") for i, t in before], [(i, t) for i, t in ITEMS if t])
    want = [(i, t) for i, t in before if not leaks[i]]
    docs = p.stored(stages["decontamination"](spark, docs, sf), "d")
    assert texts(docs) == want and not {208, 209} & set(dict(want))

    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    ids = dict(zip([i for i, _ in want], reference_ids("byte_bpe_50k.json", [t for _, t in want]), strict=True))
    by_doc, by_sequence = {}, {}
    for r in packed:
        x = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).extend(x)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: len(x) for i, x in by_doc.items()} == {i: len(x) for i, x in ids.items()}
    for s in by_sequence.values():
        assert [a for a, _ in sorted(s)] == [0, *np.cumsum([b for _, b in sorted(s)])[:-1].tolist()] and sum(b for _, b in s) <= 1024
    assert len(by_sequence) <= len(packing.best_fit(np.array([r.length for r in packed]), 1024)) + 1
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, p.run(spark, sf).collect())) == sorted(map(key, packed))
