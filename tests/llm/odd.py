"""Small tables with everything an operator must live with."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside or add.
CLASHES = (
    "fp component_id h f n owner mark shard copy drops n_lines n_dropped kept_text digest norm points file keep_id kept group_size "
    "spans kinds trigram size source_key target taken passes pieces quota start length doc_tokens sequence_id lang_pred score held_out "
    "n_words script base_failed n_sentences removed low high first main_text a b u v root node"
).split()


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for _ in range(words):
        w = f"w{rng.randrange(vocabulary)}x"
        out.append(w + rng.choice(["", "", "", "", ".", ","]) + rng.choice(["", "", "", "", "", "\n"]))
    return " ".join(out)


def rows(seed: int = 1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    line = "A shared line of more than ten characters"
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""]), len(t)) for i, t in enumerate(base)]
    out += [
        (20, None, None, None, None), (21, "", "en", "s1", 0), (22, "  \n\t ", "en", "s1", 5), (23, "\n\n", None, "s9", 2),
        (24, base[0], "en", "s2", None), (25, base[0].replace(" ", "  ") + " ", "en", "s2", None),  # copies
        (26, base[1] + "\n" + line, "de", "s1", None), (27, line.upper() + "\n" + base[2], "de", "s1", None), (28, "  " + line, "de", "s1", None),
        (29, base[3] + " tail", "en", "s3", None), (3, base[3], "xx", "s1", 1), (3, base[3], "xx", "s1", 1),  # repeated rows and ids
        (3, "another text under the id of one that is there", "en", "s1", 1),
        (None, base[4], "en", "s1", 7), (None, "one without an id", None, None, 7), (None, None, None, None, None),
        (30, "ſecret tokeN = 'abcdef' AKIA" + "Z" * 16 + " " + "0f" * 14 + " é ü 漢字 \U0001f600 é", "en", "s4", None),
        (31, " ".join(f"long{i % 977}" for i in range(60_000)), "en", "s4", None),  # very long
        (32, "x" * 300_000, "en", "s4", None), (33, "same words " * 40, "en", "s4", None), (34, "0 1 2 !? --", "en", "s4", None),
    ]
    return out


def table(spark, data=None, partitions: int = 4):
    df = spark.createDataFrame(rows() if data is None else data, DDL)
    return df.repartition(partitions).withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def empty(spark):
    return table(spark, [], 1)


def text_of(t):
    return t or ""
