import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import licences
from tests.llm.test_licences import CLEAN, model  # noqa: F401


def found(spark, model, text):
    rows = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).where("confirmed").collect()
    return sorted((r["line"], r["family"]) for r in rows)


APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
PROSE = "people use this free software for work and keep every file that they copy in a public place "


@pytest.mark.parametrize("between", ["\n", " "])
def test_dual_notices(spark, model, between):  # noqa: F811
    assert found(spark, model, f"{APACHE}{between}{MIT}") == [(0, "apache-2.0"), (int(between == "\n"), "mit")]


def test_a_notice_within_a_long_line(spark, model):  # noqa: F811
    assert found(spark, model, PROSE * 50 + APACHE + " " + PROSE * 50) == [(0, "apache-2.0")]


def test_a_wrapped_notice_between_other_lines(spark, model):  # noqa: F811
    gpl = licences.TEMPLATES["gpl-3.0"][4].split()
    wrapped = [" ".join(gpl[k : k + 5]) for k in range(0, len(gpl), 5)]
    assert found(spark, model, "\n".join([PROSE] * 6 + wrapped + [PROSE] * 6)) == [(6, "gpl-3.0")]


def test_capitals_that_grow_in_lower_case(spark, model):  # noqa: F811
    assert found(spark, model, "\u0130" * 30 + f"\n{APACHE}\n{MIT}") == [(1, "apache-2.0"), (2, "mit")]


def test_all_pairs_of_short_notices(spark, model):  # noqa: F811
    short = {f: t[0] for f, t in licences.TEMPLATES.items() if len(licences.words(t[0])) < 16}
    pairs = [(a, b) for a in short for b in short if a != b]
    df = spark.createDataFrame([(k, f"{short[a]}\n{short[b]}\n{CLEAN[0]}") for k, (a, b) in enumerate(pairs)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.label_documents(df, model).collect()}
    right = sum(set((got.get(k) or "").split("|")) == set(p) for k, p in enumerate(pairs))
    print("pairs", len(pairs), "both found", right)
    assert right == len(pairs)


def brute(text, confirm=licences.CONFIRM):
    """Families of which some stretch of words, as long as a template and a third, holds enough bigrams."""
    w, out = licences.words(text or ""), set()
    for family, templates in licences.TEMPLATES.items():
        for t in map(licences.words, templates):
            need, reach = set(zip(t, t[1:])), len(t) + len(t) // 3 + 4
            if any(len(need & set(zip(part, part[1:]))) >= confirm * len(need) for k in range(len(w)) for part in [w[k : k + reach]]):
                out.add(family)
    return out


def test_fit_and_label_documents_against_brute_force(spark):
    """What the query runs, over a table that holds notices whole, reworded, repeated, in ties, and none."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    families = sorted(licences.TEMPLATES)
    rows, planted = [], {}
    for k in range(150):
        own = rng.sample(families, k % 3)
        parts = [prose(rng.randint(3, 60))]
        for f in own:
            parts += [rng.choice(licences.TEMPLATES[f]), prose(rng.randint(3, 60))]
        rows.append((k, rng.choice(["\n", "\n\n"]).join(parts)))
        planted[k] = set(own)
    rows += [(150, None), (151, ""), (3, rows[3][1]), (152, prose(50_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("families", F.lit("clash"))
    model = licences.fit(df)
    got = {r["doc_id"]: set(r["families"].split("|")) - {""} for r in licences.label_documents(df, model).collect()}
    for k, text in rows:
        assert planted.get(k, set()) <= got.get(k, set()) <= brute(text), (k, text)
    empty = licences.fit(df.limit(0))
    assert licences.label_documents(df.limit(0), empty).count() == 0
