"""Small tables with every edge case, as Parquet folders."""

from __future__ import annotations

import random
import tempfile

SYLLABLES = {"en": "the and ing er re on an th tion ed".split(), "de": "der die sch ung ein ch ver keit en ü".split()}


def prose(rng: random.Random, lang: str = "en", words: int = 60) -> str:
    out = []
    for i in range(words):
        w = "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5)))
        out.append(w + (".\n" if i % 12 == 11 else ""))
    return " ".join(out)


def documents(n: int = 40, seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with copies, shared lines, nulls, empties, repeats and a very long text."""
    rng = random.Random(seed)
    shared = ["This line stands in many documents.", "  THIS line stands in many documents.  ", "Another shared line, quite long too."]
    rows = []
    for i in range(n):
        lang = "de" if i % 4 == 3 else "en"
        text = prose(rng, lang, rng.randrange(1, 160))
        if i % 3 == 0:
            text += "\n" + shared[i % 2] + "\n" + shared[2] + "\n" + shared[2]
        rows.append((i, text, lang, f"src{i % 3}" if i % 5 else "src0"))
    rows[5] = (5, rows[4][1], rows[4][2], "src1")
    rows[7] = (7, None, "en", None)
    rows[8] = (8, "", None, "src2")
    rows[9] = (9, " \n\n\t", "en", None)
    rows[10] = (10, "😀 émigré 中文 <|endoftext|> x", "en", "src1")
    rows[11] = (11, prose(rng, "en", 9000), "en", "src0")
    rows[12] = (None, "a text without an id", None, "src0")
    rows.append(rows[2])
    rows.append(rows[2])
    rows.append((2, "another text under an id that stands already", "en", "src2"))
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, rows: list[tuple], name: str = "documents", schema: str = SCHEMA) -> str:
    path = tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return path
