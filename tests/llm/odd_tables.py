"""Tables with everything that an operator must bear: nulls, empty and very long texts, repeated rows, clashing names."""

import re

CLASHING = ("row", "key", "doc", "id", "hash", "pos", "kept", "failed", "part", "n", "template", "component_id", "candidates", "m")

PROSE = ("The harbour lay quiet in the early morning while two fishermen mended their nets beside the old stone wall and talked about the weather. "
         "A boat came in slowly from the west, its sail patched with grey cloth, and nobody on the quay seemed to know its name. "
         "Later that day the market opened under a bright sky, and people walked between stalls of bread, apples, lamps and wool until dusk.")


def long_text(words=20_000):
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(words))


def odd_rows():
    return [
        (1, PROSE), (2, PROSE), (3, PROSE.replace("morning", "evening")), (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "two words"),
        (None, PROSE + " Null id."), (None, None), (9, long_text()), (10, "same line\n" * 60), (11, "#" * 300), (1, PROSE), (12, "é ß 中文 😀 " * 20),
    ]


def documents(spark, rows=None, extra=False):
    rows = odd_rows() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", *[f"doc_id as `{c}`" for c in CLASHING])
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
