"""Small tables with the awkward cases every operator must take: nulls, empty and long texts, copies, ties."""

import random

from pyspark.sql import types as T

_SYLLABLES = ["ba", "ko", "ri", "tu", "sen", "mal", "ot", "ve", "Zü", "ñe"]


def sentence(rng, words):
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def texts():
    rng = random.Random(5)
    passage, long_one = sentence(rng, 60), sentence(rng, 400)
    made = [sentence(rng, rng.randint(12, 160)) for _ in range(24)]
    made += [made[0], made[1], made[0] + "\n", made[2] + " end", long_one, long_one.replace(" ", "  ", 3)]
    made += [sentence(rng, 20) + "\n" + passage + ".\n" + sentence(rng, 30) for _ in range(5)]
    made += [passage + " " + sentence(rng, 5) + " " + passage, "one two three\n" * 80, "word", "", None, " \n\t ", "12 34 !!", "A b  c"]
    made += [sentence(rng, 3000), "x" * 5000, "SHOUT!! " * 40, "a" + "&&& b### " * 60, "Ünï codé \x85 <|endoftext|> </s>"]
    return made


def documents(spark):
    """Rows with columns whose names clash with what the operators use inside."""
    rows = [(i, t, None if i % 9 == 0 else "xx", "src", None if t is None else len(t), i, "k", b"w", 1) for i, t in enumerate(texts())]
    rows += [(None, "no number at all but words enough to be a document of its own here", "xx", None, None, None, None, None, None)]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, text_key string, words binary, cut_words int"
    return spark.createDataFrame(rows, schema)


def empty(frame):
    return frame.sparkSession.createDataFrame([], frame.schema)


def labels(spark):
    rows = [(i, int(i not in (39, 47, 48)), int(i == 5)) for i in range(0, 50, 1)] + [(None, 0, 1), (3, None, None), (999, 0, 0)]
    return spark.createDataFrame(rows, T.StructType.fromDDL("doc_id long, quality int, toxic int"))


def benchmark(spark):
    own = texts()
    words = own[30].split()
    rows = [(1, " ".join(words[2:40])), (2, own[7].upper()), (3, own[36][:200]), (4, "ba ko"), (5, None), (6, "..."), (2, own[7]), (None, own[9])]
    return spark.createDataFrame(rows, "item_id long, text string")
