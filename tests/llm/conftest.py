import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(5)
    syllables = "the er ing of and tion ly bo mi ra ko zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(5, 150))]
        if i % 6 == 0:
            words += passage.split()
        out.append([i, " ".join(words) + ".", rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", None])])
    base = out[7][1].split()
    for i in range(60, 72):  # near copies of one text, some of them near each other only
        edited = list(base)
        for _ in range(rng.randint(0, 2)):
            edited[rng.randrange(len(edited))] = word()
        out.append([i, " ".join(edited), "en", "src0"])
    out += [[72, out[3][1], "en", "src1"], [73, "  " + out[3][1] + "\n", "en", "src1"], [74, None, None, None], [75, "", "en", "src0"], [76, " \t\n", "de", "src9"], [77, "one two", "en", "other"], [78, "ONE two", "en", "src3"]]
    out += [[79, "xq" * 3000, "en", "src0"], [80, "ab " * 2500, "de", "src0"], [81, "Ünï çödé 日本語 🙂 é <|endoftext|>'s!!", "fr", "src5"], [82, "12345 !!", "en", "src1"]]
    out += [[83, " ".join(word() for _ in range(3000)), "en", "src0"]]
    out.append(list(out[5]))  # a repeated row
    out.append([None, out[9][1], "en", "src2"])
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    extra = ["chunk", "bucket", "kind", "n", "fp", "p", "h", "row", "learns", "word", "rare", "region", "label", "edited", "next", "domain", "tokens", "key", "epochs", "slice", "kept", "keep_id", "score", "lang_pred", "component_id", "_epoch"]
    return docs.select("*", *(F.lit("x").alias(c) for c in extra))
