import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import licences

CLEAN = ["The quick brown fox jumps over the lazy dog near the old river bank.", "We took the children to the park and they played until it was dark.", "Please renew your driving license before the end of the month.", "Le chat est sur la table.", ""]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    vocabulary = [w for c in CLEAN for w in c.split()] + ["".join(rng.choice("aeioutrnsl") for _ in range(6)) for _ in range(200)]
    return licences.train([" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) for _ in range(600)])


def test_held_out_variants(model):
    rng = random.Random(2)
    right = total = 0
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            for _ in range(5):
                w = licences.words(t)
                if len(w) > 6:
                    w.pop(rng.randrange(len(w)))
                total += 1
                right += model.families[int(model.probabilities(w).argmax())] == family
    assert right / total > 0.93


def test_clean_paragraphs_are_unknown(model):
    for text in CLEAN:
        assert model.families[int(model.probabilities(licences.words(text)).argmax())] == licences.UNKNOWN


def test_scan(spark, model):
    mit = licences.TEMPLATES["mit"][-1]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)).replace("mod\nify", "modify")
    rows = [(1, f"{CLEAN[0]}\nLicensed under the Apache License, Version 2.0.\n{CLEAN[1]}"), (2, CLEAN[2]), (3, None), (4, ""), (5, "LICENSED UNDER CC BY-NC 4.0!!\n" + "word " * 20_000), (6, f"{CLEAN[3]}\n\n{mit}\n"), (6, f"{CLEAN[3]}\n\n{mit}\n"), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = sorted(((r["doc_id"], r["line"], r["family"], r["confirmed"]) for r in licences.scan(df, model).collect()), key=repr)
    assert got == sorted([(1, 1, "apache-2.0", True), (5, 0, "cc-by-nc", True), (6, 2, "mit", True), (6, 2, "mit", True), (None, 0, "mit", True)], key=repr)
    assert licences.scan(df.limit(0), model).count() == 0
