"""Small tables with the odd cases that every operator must stand."""

LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while the small cat sleeps near the warm fire and dreams of mice running through the tall grass at night under a bright moon with many stars above the quiet hills"

DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept int, digest string, size int, _id long, _n long, _keep_doc_id long, _doc_id long, sequence_id long, row string, block int, `a.b` string"

ROWS = [
    (1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, PROSE), (7, PROSE + "  "), (8, "one"), (9, "été à la plage, naïve œuvre"), (10, PROSE.replace("quick", "slow")),
    (None, PROSE), (None, None), (12, "x" * 50_000), (1, PROSE), (13, "日本語 \U0001f600 text"),
]


def documents(spark, rows=None):
    """Rows (doc_id, text) with nulls in the other columns and columns whose names clash with operators' own."""
    rows = ROWS if rows is None else rows
    full = [(d, t, None if k % 4 == 0 else ["en", "fr"][k % 2], None if k % 5 == 0 else f"s{k % 3}", None, "clash", k, "clash", k, k, k, k, k, k, "clash", k, "dot") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC)
