"""Small documents with every kind of oddity, and columns whose names operators use themselves."""

LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(20000))
TEXTS = [
    (1, "One line here.\nAnother line there.", "en", "a"),
    (1, "One line here.\nAnother line there.", "en", "a"),
    (1, "The same number, another text altogether.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, " \n\t ", None, "b"),
    (5, "12 34 ... !!", "en", "b"),
    (6, LONG, "en", "b"),
    (None, "A text without a number. It has two sentences.", "en", "a"),
    (None, None, None, None),
    (7, "x", "de", "c"),
    (8, "Überall   ist Weißraum.\r\nУлица и дом 😀 漢字", "de", "c"),
]
EXTRA = "row long, fp long, label string, h long, cell int, spans string, id long, host string, _llm_row long, n_dropped long, leak_id long"


def documents(spark, rows=TEXTS):
    extra = (0, 0, "", 0, 0, "", 0, "", 0, 0, 0)
    data = [(*r, len(r[1] or ""), *extra) for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
