"""Small tables with everything that may go wrong."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=1):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 4096 % 7) * (x % 3 == 0))
    return " ".join(out)


PASSAGE = prose(70, 99)

DOCUMENTS = [
    (1, prose(120, 1)),
    (2, prose(120, 1)),
    (3, prose(40, 3) + " " + PASSAGE + " " + prose(40, 4)),
    (4, prose(30, 5) + " " + PASSAGE + " " + prose(60, 6)),
    (5, None),
    (6, ""),
    (7, "   \n\t "),
    (8, "one"),
    (9, "ONE"),
    (10, "élan ü 😀 " + prose(50, 7)),
    (11, "x" * 5000),
    (12, "\n".join(f"line {i} {prose(6, i)}" for i in range(30))),
    (13, "\n".join(["first here", *[f"line {i} {prose(6, i)}" for i in range(10, 16)], "last here"])),
    (14, prose(118, 1)),
    (15, prose(20000, 8)),
    (-3, PASSAGE),
    (None, PASSAGE),
    (None, None),
    (16, "a\nb"),
    (17, "a\nb\nc\na\nb\nc\na"),
]


def documents(spark, rows=None, clash=True):
    """Repeated rows, and extra columns whose names the operators may use themselves."""
    rows = DOCUMENTS + [DOCUMENTS[0], DOCUMENTS[2]] if rows is None else rows
    if not clash:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = "id, uid, n, sketch, block, bucket, pos, marks, score, key, node, kind, ids, keys, a, b, label, _kept, n_chars, lang".split(", ")
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def key(doc_id):
    return (doc_id is None, doc_id or 0)
