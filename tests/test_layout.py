"""Blocks of pages, heading trees, drawings and rounds of retrieval, by hand and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import drawings, layout
from siltstone.plans import retrieve

WORDS = "page long, top double, x0 double, x1 double, bottom double, text string"


def line(page, top, *words, height=10):
    return [(page, float(top), float(x0), float(x1), float(top + height), t) for x0, x1, t in words]


PAGE = [
    *line(1, 0, (10, 60, "Report"), (65, 90, "of"), (95, 140, "Sales")),
    *line(1, 20, (10, 40, "it"), (45, 80, "runs"), (85, 120, "on.")),
    *line(1, 32, (10, 40, "and"), (45, 80, "on.")),
    *line(1, 70, (10, 40, "far"), (45, 80, "below.")),
    *line(1, 90, (10, 40, "name"), (100, 130, "city"), (200, 230, "n")),
    *line(1, 110, (12, 40, "Ann"), (44, 60, "B"), (98, 130, "Rome"), (203, 230, "7")),
    *line(1, 130, (10, 40, "Bob"), (100, 130, "Oslo"), (200, 230, "9")),
    *line(1, 150, (10, 40, "two"), (150, 180, "cells.")),
    *line(1, 170, (10, 20, "1."), (25, 60, "first.")),
    *line(1, 190, (10, 20, "[ref]")),
    *line(1, 210, (10, 20, " "), (30, 40, None)),
    *line(2, 0, (10, 60, "left"), (62, 90, "side.")),
    *line(2, 12, (300, 360, "right"), (362, 390, "side.")),
]


def test_page_blocks_by_hand(spark):
    words = spark.createDataFrame(PAGE, WORDS).withColumn("row", F.lit("clash")).repartition(4)
    got = {(r["page"], r["block"]): (r["layout_type"], r["text"], r["n_rows"], r["n_columns"]) for r in layout.page_blocks(words).collect()}
    assert got == {
        (1, 0): ("title", "Report of Sales", 1, 1),
        (1, 1): ("paragraph", "it runs on.\nand on.", 2, 1),
        (1, 2): ("paragraph", "far below.", 1, 1),
        (1, 3): ("table", "name\tcity\tn\nAnn B\tRome\t7\nBob\tOslo\t9", 3, 3),
        (1, 4): ("paragraph", "two cells.", 1, 2),
        (1, 5): ("list_item", "1. first.", 1, 1),
        (1, 6): ("reference", "[ref]", 1, 1),
        (2, 0): ("paragraph", "left side.", 1, 1),
        (2, 1): ("paragraph", "right side.", 1, 1),
    }
    assert layout.page_blocks(words.limit(0)).count() == 0


def blocks_by_loops(words):
    """Rows, cells, tables and blocks in plain loops; (page, type, text) in order."""
    out = []
    for page in sorted({w[0] for w in words}):
        rows = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (w[1], w[2], w[3], w[4], w[5] or "")):
            if not rows or abs(w[1] - rows[-1][0][1]) > layout.ROW_HEIGHT:
                rows.append([])
            rows[-1].append(w)
        made = []
        for row in rows:
            row = sorted((w for w in row if (w[5] or "").strip()), key=lambda w: (w[2], w[3], w[1], w[4], w[5]))
            cells = []
            for k, w in enumerate(row):
                if k and w[2] - row[k - 1][3] <= layout.CELL_GAP:
                    cells[-1].append(w)
                else:
                    cells.append([w])
            if cells:
                made.append((cells, min(w[2] for w in row), max(w[3] for w in row), min(w[1] for w in row), max(w[4] for w in row)))
        k = 0
        while k < len(made):
            end = k + 1
            while end < len(made) and len(made[k][0]) >= 2 and len(made[end][0]) == len(made[end - 1][0]) and all(abs(a[0][2] - b[0][2]) <= layout.COLUMN_SHIFT for a, b in zip(made[end][0], made[end - 1][0])):
                end += 1
            words_of = lambda cells: [" ".join(w[5].strip() for w in c) for c in cells]
            if end - k >= 2:
                out.append((page, "table", "\n".join("\t".join(words_of(m[0])) for m in made[k:end])))
            else:
                end, text = k + 1, " ".join(words_of(made[k][0]))
                kind = "title" if text[:1].isupper() and not set(text) & set(".!?") or text.isupper() else "paragraph"
                m, before = made[k], made[k - 1] if k else None
                if kind == "paragraph" and out and out[-1][:2] == (page, "paragraph") and m[3] - before[4] <= layout.LINE_GAP and m[1] <= before[2] and m[2] >= before[1]:
                    out[-1] = (page, "paragraph", out[-1][2] + "\n" + text)
                else:
                    out.append((page, kind, text))
            k = end
    return out


def test_page_blocks_equal_loops(spark):
    rng = random.Random(7)
    words = []
    for page in range(25):
        top = 0
        for _ in range(rng.randint(1, 25)):
            top += rng.choice([11, 14, 21, 30])
            xs = sorted(rng.sample([10, 60, 110, 112, 160, 260, 263, 360], rng.randint(1, 4)))
            words += line(page, top + rng.choice([0, 0, 2]), *((x, x + rng.choice([20, 34, 45]), rng.choice(["Big", "small", "end.", "7"])) for x in xs))
    got = layout.page_blocks(spark.createDataFrame(words, WORDS).repartition(3)).orderBy("page", "block").collect()
    assert [(r["page"], r["layout_type"], r["text"]) for r in got] == blocks_by_loops(words)


def test_heading_tree(spark):
    rng = random.Random(2)
    rows = [(doc, k, rng.choice([1, 2, 3, 4, 5, 6, 0, 9]), f"h{doc}.{k}") for doc in range(20) for k in range(rng.randint(1, 40))]
    want = {}
    for doc in range(20):
        stack = []
        for _, k, level, text in sorted(r for r in rows if r[0] == doc):
            level = level if 1 <= level <= 6 else 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            want[doc, k] = (stack[-1][1] if stack else None, [t for _, _, t in stack] + [text])
            stack.append((level, k, text))
    df = spark.createDataFrame(rows, "doc_id long, position long, level int, text string").withColumns({"parent": F.lit("clash"), "path": F.lit(1)})
    assert {(r["doc_id"], r["position"]): (r["parent"], r["path"]) for r in layout.heading_tree(df.drop("parent", "path")).collect()} == want


def drawn(spark, kind, text):
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, content string")
    e = [(r["type"], r["name"], r["detail"]) for r in drawings.entities(rows, kind).orderBy("ord").collect()]
    r = [(r["a"], r["b"], r["type"], r["label"]) for r in drawings.relations(rows, kind).orderBy("ord").collect()]
    c = {r["id"]: r["confidence"] for r in drawings.confidence(rows, kind).collect()}
    assert c == {1: drawings.CONFIDENCE[kind], 2: drawings.UNSURE, 3: drawings.UNSURE}
    return e, r


def test_class_drawings(spark):
    text = "Order {\n + id: int\n - note\n total\n\n + pay(amount, how): bool\n # close()\n}\nItem { size: long }\nOrder -- Item\nOrder <|> Base two words"
    e, r = drawn(spark, "class", text)
    assert e == [("class", "Order", ""), ("class", "Item", "")]
    assert r == [("Order", "Item", "dependency", ""), ("Order", "Base", "association", "")]
    got = drawings.members(spark.createDataFrame([(1, text)], "id long, content string")).orderBy("class", "ord").collect()
    assert [(m["class"], m["member"], m["name"], m["visibility"], m["type"], m["params"]) for m in got] == [
        ("Item", "attribute", "size", "#", "long", None),
        ("Order", "attribute", "id", "+", "int", None),
        ("Order", "attribute", "note", "-", "unknown", None),
        ("Order", "attribute", "total", "#", "unknown", None),
        ("Order", "method", "pay", "+", "bool", "amount, how"),
        ("Order", "method", "close", "#", "void", ""),
    ]


@pytest.mark.parametrize(
    "kind,text,entities,relations",
    [
        ("sequence", "Ann: a user\nAnn ->> Shop: buy it\nShop --> Ann: done\nAnn: again\nShop: a shop\nx -> y: z", [("object", "Ann", ""), ("object", "Shop", "")], [("Ann", "Shop", "sync", "buy it"), ("Shop", "Ann", "async", "done"), ("x", "y", "sync", "z")]),
        ("c4", "[Web App] (React)\n [Store]\nweb -> store\nstore -- store\na -- b", [("container", "Web App", "React"), ("container", "Store", "")], [("web", "store", "uses", ""), ("a", "b", "uses", "")]),
        ("component", "<<component>> Cart { }\nnothing\n<<x>> Pay", [("component", "Cart", ""), ("component", "Pay", "")], []),
        ("deployment", "Server [node]\nnode B\nother", [("node", "Server", ""), ("node", "node B", "")], []),
        ("activity", "Start (now)\nStart -> Pay\nlow\nPay -> Ship -> Done\nShip", [("action", "Start", ""), ("action", "Ship", "")], [("Start", "Pay", "flow", "")]),
        ("state", "Idle\nIdle --> Busy [go]\nbusy\nBusy --> Idle", [("state", "Idle", "")], [("Idle", "Busy [go]", "transition", "go"), ("Busy", "Idle", "transition", "")]),
        ("package", "package shop\nFolder x\nshop::cart\na::b::c", [("package", "shop", ""), ("package", "x", "")], [("shop", "cart", "import", "")]),
        ("object", "cart: Cart\ncart -- item\nx -> y", [("Cart", "cart", "instance")], [("cart", "item", "link", "")]),
        ("use_case", "actor Ann: buyer\nuse case Pay\nPay <extends> Buy\nPay include Log\nbob: x\nactor Ann: buyer", [("actor", "actor Ann", ""), ("use_case", "Pay", ""), ("actor", "bob", "")], [("Pay", "Buy", "extends", ""), ("Pay", "Log", "include", "")]),
        ("erd", "users(id PK)\norders(user FK)\nusers(again)\nusers -- orders N\na --- b", [("id PK", "users", "primary"), ("user FK", "orders", "foreign")], [("users", "orders N", "foreign_key", "1:N"), ("a", "b", "foreign_key", "1:1")]),
    ],
)
def test_drawings_by_hand(spark, kind, text, entities, relations):
    e, r = drawn(spark, kind, text)
    assert (e, r) == (entities, relations)


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        drawings.entities(spark.createDataFrame([(1, "x")], "id long, content string"), "sculpture")


def given(spark, rows):
    """A source that gives the rows whose content holds a word of the query, best first."""
    def source(name, held):
        def search(query, limit):
            hits = [(c, s) for c, s in held if set(c.split()) & set(query.split())]
            best = sorted(hits, key=lambda x: (-x[1], x[0]))[:limit]
            return spark.createDataFrame([(name, f"{name}{k}", c, s, k + 1) for k, (c, s) in enumerate(best)], retrieve.SCHEMA)

        return search

    return {name: source(name, held) for name, held in rows.items()}


HELD = {
    "docs": [("alpha bravo charlie", 0.2), ("alpha delta echoes", 0.3), ("bravo forests", 0.1)],
    "code": [("alpha bravo charlie", 0.4), ("charlie code lines", 0.5), ("delta gammas", 0.3)],
    "graph": [("forests graph", 0.9)],
}


def replay(query, limit, rounds, least, confident):
    average, seen, told, now, total = dict.fromkeys(HELD), [], [], query, 0
    for k in range(rounds):
        name = max(HELD, key=lambda n: (1.0 if average[n] is None else average[n], -list(HELD).index(n)))
        hits = sorted(((c, s) for c, s in HELD[name] if set(c.split()) & set(now.split())), key=lambda x: (-x[1], x[0]))[:limit]
        new = [(c, s) for c, s in hits if c not in [x for x, _, _ in seen]]
        seen += [(c, s, k + 1) for c, s in new]
        total += len(new)
        mean = sum(s for _, s in new) / len(new) if new else 0.0
        confidence = max(0.0, min(1.0, mean + min(total / 10, 0.3) - min(k * 0.1, 0.3))) if new else 0.0
        average[name] = mean if average[name] is None else (average[name] + mean) / 2
        done = total >= least and confidence >= confident
        terms = set(now.lower().split())
        for c, _, _ in seen[:3]:
            terms.update([w for w in c.lower().split() if len(w) > 4 and w not in terms][:2])
        refined = " ".join(sorted(terms))
        told.append((name, now, len(new), round(confidence, 9), None if done or refined == now else refined))
        if done or refined == now:
            break
        now = refined
    return [(c, r) for c, _, r in seen], told


@pytest.mark.parametrize("query,limit,rounds,least,confident", [("alpha", 10, 3, 3, 0.7), ("alpha", 1, 5, 9, 0.7), ("bravo", 10, 6, 3, 0.99), ("nothing", 10, 3, 3, 0.7), ("forests", 10, 3, 1, 0.2)])
def test_rounds_of_unseen_rows_equal_a_replay(spark, query, limit, rounds, least, confident):
    found, told = retrieve.unseen(spark, given(spark, HELD), query, limit, rounds, least, confident)
    want, steps = replay(query, limit, rounds, least, confident)
    assert sorted((r["content"], r["round"]) for r in found.collect()) == sorted(want)
    assert [(t.source, t.query, t.new, round(t.confidence, 9), t.refined) for t in told] == steps


def test_adaptive_steps(spark):
    sources = given(spark, HELD)
    rows = lambda intent, limit: sorted({r["step"] for r in retrieve.adaptive(spark, sources, ["docs", "missing", "code", "graph"], "alpha bravo forests", intent, limit).collect()})
    assert rows("design", 1) == rows("troubleshoot", 1) == [0, 2, 3]
    assert rows("explain", 3) == [0] and rows("explain", 4) == [0, 2] and rows("explain", 99) == [0, 2, 3]
