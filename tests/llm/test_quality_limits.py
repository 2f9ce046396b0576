import random

from meterloom.llm import quality


def text(rng, n, common=0.4):
    return " ".join(rng.choice(quality.COMMON["en"]) if rng.random() < common else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n))


def test_junk_of_any_length_goes(spark):
    rng = random.Random(3)
    clean = [(i, text(rng, n), "en") for i, n in enumerate([12, 30, 60, 90, 130, 200, 400, 2000] * 12)]
    # no common words at 120 words; fewer than there should be in a long text; symbols in a short one
    junk = [(1000 + i, text(rng, 120, 0.0), "en") for i in range(2)] + [(1010 + i, text(rng, 2000, 0.15), "en") for i in range(2)]
    junk += [(1020 + i, " | # ".join(text(rng, 40).split()), "en") for i in range(2)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.drop_low_quality(df).collect()}
    assert kept == {r[0] for r in clean}
