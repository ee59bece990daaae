"""Small tables with every awkward case, for the corpus operators."""

import random

SYLLABLES = "an ba ce do el fi go ha in jo ka lu me no or pa que re st ti un ver wo xi ys zo".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, rest string, leaks string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


LONG = prose(1, 6000)
SHARED = prose(2, 120)
BOILERPLATE = "All rights reserved by the Nobody Company.\n"


def texts() -> list[tuple[int | None, str | None]]:
    """Null, empty and very long texts, copies, near copies, repeated rows, shared passages and lines."""
    near = SHARED.split()
    near[60] = "changed"
    rows = [(i, prose(100 + i, 30 + 17 * i) + "\n" + BOILERPLATE * (i % 3) + prose(200 + i, 20)) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "   \n\t\n"), (33, LONG), (34, LONG), (35, LONG + " tail"), (36, SHARED), (37, SHARED), (38, " ".join(near)), (39, prose(5, 40) + " " + SHARED + " " + prose(6, 40))]
    rows += [(40, "ab " * 800), (41, "Ünïcödé straße ß " * 40 + "\n  " + BOILERPLATE), (42, "a"), (43, "日本語のテキスト。" * 60), (44, "UPPER CASE!! WORDS!! HERE!!"), (44, "UPPER CASE!! WORDS!! HERE!!"), (45, "x\x00y 'quoted' it's\r\nnew"), (None, SHARED + " without an id"), (None, None)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}" if i != 5 else None, len(t or ""), "s", "l", "r", "k") for i, t in rows], COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
