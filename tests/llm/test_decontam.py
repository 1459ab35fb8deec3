import random

import pytest
import regex
from pyspark.sql import functions as F

from siltstone.llm import decontam as dc

ITEM = "If Anna buys 12 apples for 3 dollars each at the market then how much does Anna pay in total"
OTHER = "If Maria buys 45 apples for 7 dollars each at the market then how much does Maria pay in total"
TORN = "If Maria buys 45 apples for 7 dollars each at the market then how much does Petra pay in total"
FILLER = "the old house by the river was sold to a young couple who wanted to live near the water"


def words(text):
    """(type or None, value) of each word, letter by letter, from the rules in README and docstring."""
    t = text or ""
    out, k = [], 0
    while k < len(t):
        if t[k].isdecimal():
            e = k
            while e < len(t) and (t[e].isdecimal() or (t[e] in ".,:" and e + 1 < len(t) and t[e + 1].isdecimal())):
                e += 1
            value = "".join(c for c in t[k:e] if c.isdecimal())
            tail = t[e:].split(" ")[0] if t[e : e + 1] != " " else t[e + 1 :].split(" ")[0]
            near = regex.match(rf"(?i)({dc.UNITS})(?![\p{{L}}\p{{N}}])", tail)
            if near:
                out += [("number", value), ("unit", near[0].lower())]
                k = e + (t[e : e + 1] == " ") + len(near[0])
                continue
            while e < len(t) and t[e].isalnum():
                value += t[e].lower()
                e += 1
            out.append(("number", value))
            k = e
        elif t[k].isalpha():
            e = k + 1
            while e < len(t) and (t[e].isalnum() or (t[e] in "'\u2019" and t[e - 1].isupper() and t[e + 1 : e + 2].isupper())):
                e += 1
            w = t[k:e].replace("'", "").replace("\u2019", "")
            low = w.lower()
            name = w[0].isupper() and w.isalpha() and low not in dc.FUNCTION_WORDS.split("|")
            if name and w.isupper():
                before, after = regex.search(r"(\p{Lu}\p{Lu})[^\p{L}\p{N}]{1,4}$", t[max(0, k - 6) : k]), regex.match(r"[^\p{L}\p{N}]{1,4}\p{Lu}\p{Lu}", t[e : e + 6])
                name = not before and not after
            out.append(("name" if name else None, low))
            k = e
        else:
            k += 1
    return out


def number_word(w):
    return w[1] in dc.NUMBER_WORDS.split("|") and w[0] is None


def brute(docs, items):
    out = set()
    slot = lambda w: w[0] or ("number" if number_word(w) else None)
    open_ = lambda ws: tuple((slot(w), None if slot(w) else w[1]) for w in ws)
    plain = lambda ws: tuple((None, w[1]) if slot(w) in (None, "name") else (slot(w), None) for w in ws)
    for d, text in docs:
        dt, places = words(text), {}
        for i, question in items:
            it = words(question)
            n = min(dc.WINDOW, len(it))
            if n not in places:
                places[n] = {}
                for q in range(len(dt) - n + 1):
                    places[n].setdefault(open_(dt[q : q + n]), []).append(q)
            lines = {}
            for p in range(len(it) - n + 1) if n else ():
                item = it[p : p + n]
                strict = sum(map(bool, map(slot, item))) * 2 > n or n < dc.SHORTEST
                for q in {*places[n].get(open_(item), []), *places[n].get(plain(item), [])}:
                    pairs = [(p + k, a[1], b[1]) for k, (a, b) in enumerate(zip(item, dt[q : q + n])) if slot(a)]
                    if not strict or all(a == b for _, a, b in pairs):
                        lines.setdefault(q - p, []).append((p, pairs))
            matched, run = set(), 0
            for found in lines.values():
                met = {}  # item value: document value: places
                for at, a, b in {x for _, ps in found for x in ps}:
                    met.setdefault(a, {}).setdefault(b, []).append(at)
                stands = {a: max(v, key=lambda b: (len(v[b]), a == b, -min(v[b]))) for a, v in met.items()}
                good = {p for p, ps in found if all(a == b for _, a, b in ps) or all(stands[a] == b for _, a, b in ps)}
                run = max([run, *(k - p + n for p in good for k in range(p, len(it)) if all(x in good for x in range(p, k + 1)))])
                matched |= good
            if matched and (len(matched) >= dc.COVERAGE * max(len(it) - n + 1, 1) or run >= dc.RUN):
                out.add((d, i, len(matched), run))
    return out


def both(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "toks": F.lit(1), "pos": F.lit(2)})
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def test_other_values_are_found_and_contradicting_windows_do_not_count(spark):
    d, i = both(spark, [(1, f"{FILLER} {ITEM} {FILLER}"), (2, f"{FILLER}. {OTHER}"), (3, TORN), (4, FILLER), (5, None), (6, "")], [(7, ITEM), (8, None), (9, "")])
    got = {r["doc_id"]: r for r in dc.contaminated(d, i).collect()}
    assert set(got) == {1, 2, 3} and not got[1]["reparameterised"] and got[2]["reparameterised"] and got[2]["slots"] >= 3
    assert got[1]["matched"] == got[2]["matched"] == 13 and got[3]["matched"] == 9 and got[3]["run"] < 20


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["red", "Anna", "Paul", "12", "7.5", "km", "runs", "to", "the", "mill", "and", "back"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(3, 30))) for k in range(12)] + [(12, ITEM), (13, "five words are the least")]
    change = lambda t: " ".join({"Anna": "Olga", "12": "99"}.get(w, w) for w in t.split())
    docs = [(k, f"{text(rng.randint(0, 20))} {rng.choice([str, change])(rng.choice(items)[1])} {text(rng.randint(0, 20))}") for k in range(60)] + [(60, ITEM * 500), (61, None)]
    d, i = both(spark, docs, items)
    got = {(r["doc_id"], r["item_id"], r["matched"], r["run"]) for r in dc.contaminated(d, i).collect()}
    assert got == brute(docs, items) and len(got) > 40


FARMER = "A farmer has 12 cows and 30 sheep. He sells 12 cows for 400 dollars each and buys 8 more sheep for 90 dollars each at the fair. How many dollars does he have left after all of that is paid"


@pytest.mark.parametrize("change", [("sells 12", "sells 11"), ("has 12", "has 14"), ("sells 12 cows for 400", "sells 9 cows for 350"), ("30 sheep", "31 sheep")])
def test_one_contradicting_number_does_not_hide_a_copy(spark, change):
    d, i = both(spark, [(1, FARMER.replace(*change)), (2, FILLER)], [(7, FARMER)])
    got = dc.contaminated(d, i).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["coverage"] > 0.5
    assert {(r["doc_id"], r["item_id"], r["matched"], r["run"]) for r in got} == brute([(1, FARMER.replace(*change))], [(7, FARMER)])


def test_joins_of_any_kind_give_the_same_and_shuffle_no_tokens(spark):
    docs, items = [(1, ITEM), (2, OTHER), (3, TORN), (None, ITEM), (4, FILLER)], [(7, ITEM)]
    d, i = both(spark, docs, items)
    kept = lambda: sorted(r["doc_id"] for r in dc.clean_documents(d, i).collect())
    first, limit = kept(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert kept() == first == [4]
        plan = dc.contaminated(d, i)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


STORY = "Tom has 12 apples. Tom gives 5 apples to Ann and three pears to O'Brien. Tom then buys 4 more at the old mill by the river."
QUOTE = "a long passage of plain words that stands only once in the item and goes on for a while so that half of it is more than any quotation of it here would ever be"
CASES = [
    ("a name that opens sentences", STORY, STORY.replace("Tom", "Bob").replace("12", "31").replace("three", "seven").replace("O'Brien", "McDonald"), True),
    ("values that become equal", STORY, STORY.replace("12", "4").replace("5 ", "4 "), True),
    ("one name for two", STORY.replace("Tom gives", "Tim gives"), STORY, True),
    ("two names for one", STORY, STORY.replace("Tom gives", "Tim gives"), True),
    ("capitals", STORY, STORY.upper(), True),
    ("small letters", STORY, STORY.lower(), True),
    ("a quotation of 13 words", QUOTE, "other text before " + " ".join(QUOTE.split()[3:16]) + " and after", True),
    ("a quotation of 12 words", QUOTE, "other text before " + " ".join(QUOTE.split()[3:15]) + " and after", False),
    ("a short item", "How old is Ann?", "He asked how old is Ann? and left", True),
    ("a short item with another name", "How old is Ann?", "He asked how old is Ben? and left", False),
    ("only slots", "12 13 14 15 16 17 18 19 20", "1 2 3 4 5 6 7 8 9", False),
    ("a very long token", STORY, "x" * 300_000 + " " + STORY, True),
]


def test_what_counts_as_a_leak(spark):
    d, i = both(spark, [(k, c[2]) for k, c in enumerate(CASES)], [(k, c[1]) for k, c in enumerate(CASES)])
    got = {r["doc_id"] for r in dc.contaminated(d, i).where("doc_id = item_id").collect()}
    assert {CASES[k][0] for k in got} == {c[0] for c in CASES if c[3]}


def test_repeated_rows_and_items_are_judged_together(spark):
    d, i = both(spark, [(1, STORY), (1, STORY), (1, FILLER), (2, FILLER)], [(7, STORY), (7, STORY)])
    assert [(r["doc_id"], r["item_id"]) for r in dc.contaminated(d, i).collect()] == [(1, 7)] and dc.clean_documents(d, i).count() == 1


@pytest.mark.parametrize("none", ["docs", "items"])
def test_empty_tables(spark, none):
    d, i = both(spark, [(1, ITEM)], [(7, ITEM)])
    assert dc.contaminated(d.limit(0) if none == "docs" else d, i.limit(0) if none == "items" else i).count() == 0
