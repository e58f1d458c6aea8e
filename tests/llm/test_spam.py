import random

import pytest

from spindrift.llm import boilerplate, queries, spam
from spindrift.llm.spam import score_pages, word_counts

NOUNS = "garden river table house window stone market letter road bridge village winter summer kitchen engine number picture season farmer teacher".split()
VERBS = "sees makes finds keeps moves brings holds takes leaves shows".split()


def prose(r, n):
    return " ".join(f"The {r.choice(NOUNS)} {r.choice(VERBS)} a {r.choice(NOUNS)} in the {r.choice(NOUNS)} and it is with the {r.choice(NOUNS)} that we go to it." for _ in range(n))


def german(r, n):
    return " ".join(f"Die {r.choice(NOUNS)} ist nicht in der {r.choice(NOUNS)} und wir sind mit dem {r.choice(NOUNS)} bei den {r.choice(NOUNS)} zu Haus." for _ in range(n))


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(11)
    pages = {f"ok{i}": prose(r, r.randint(4, 20)) for i in range(240)} | {f"de{i}": german(r, r.randint(5, 20)) for i in range(120)}
    pages |= {f"word{i}": prose(r, 12).replace("river", "zork") for i in range(10)}  # one word often
    pages |= {f"list{i}": prose(r, 12) + "\n" + "\n".join(f"* {r.choice(NOUNS)}" for _ in range(8)) for i in range(10)}  # sentences with a list
    pages |= {f"key{i}": ", ".join(r.choice(["cheap", "best", "buy"]) + " boots" for _ in range(r.randint(20, 200))) for i in range(10)}
    pages |= {f"link{i}": "\n".join(f"{r.choice(NOUNS)} {r.choice(NOUNS)} - http://x{j}.test/y" for j in range(40)) for i in range(10)}
    pages |= {f"tag{i}": "\n".join(f"SKU {r.randint(1, 9999)} {r.choice(NOUNS)} size {j} in stock" for j in range(15)) for i in range(10)}
    rows = [(k, v) for k, v in pages.items()] + [("null", None), ("empty", ""), ("short", "buy boots buy boots"), (None, "buy boots " * 50), ("long", "cheap boots " * 50_000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id string, body string, words string")
    return {x.id: x for x in score_pages(spark, df).collect()}


def test_flags(scored):
    flagged = {k for k, v in scored.items() if v.flagged}
    assert {k for k in scored if k.startswith(("key", "link", "tag"))} | {"long"} <= flagged
    assert not {k for k in flagged if k.startswith(("ok", "de", "word", "list"))}


def test_pages_without_a_curve(scored):
    assert not {"null", "empty", "short", None} & scored.keys()


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([("a", "buy boots " * 40)], "id string, body string")
    assert score_pages(spark, df.limit(0)).count() == 0
    assert not score_pages(spark, df).first().flagged  # no prose to measure against


def test_counts(spark):
    df = spark.createDataFrame([("a", "A a http://x.test/a?b www.y.test é")], "id string, body string")
    assert sorted((r.word or "", r.n) for r in word_counts(df).collect()) == [("", 1), ("<address>", 2), ("a", 2)]
    chinese = spark.createDataFrame([("a", "我们我们 you")], "id string, body string")
    assert sorted(r.n for r in word_counts(chinese).collect()) == [1, 2, 2]


POLISH = "i w na z do się nie jest że to".split()
RUSSIAN = "и в не на что он с как это по".split()
CHINESE = "的 一 是 不 了 在 有 和 这 我".split()


def strange(r, function, nouns, n, gap=" "):
    """Prose of a language without a list here: two function words to each noun."""
    return gap.join(gap.join([r.choice(function), r.choice(nouns), function[min(int(r.paretovariate(1)) - 1, 9)]]) for _ in range(n)) + "."


def test_other_languages(spark):
    r = random.Random(5)
    letters = {"pl": "abcdeghijklłmnoóprsśtuwyzżźćęą", "ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "zh": "".join(map(chr, range(0x5000, 0x5000 + 600)))}
    nouns = {k: ["".join(r.choice(v) for _ in range(r.randint(4, 9) if k != "zh" else 1)) for _ in range(300)] for k, v in letters.items()}
    pages = {f"ok{i}": prose(r, r.randint(4, 20)) for i in range(240)}
    for k, function in (("pl", POLISH), ("ru", RUSSIAN), ("zh", CHINESE)):
        pages |= {f"{k}{i}": strange(r, function, nouns[k], r.randint(30, 80), "" if k == "zh" else " ") for i in range(3)}
        few = nouns[k][:6]
        pages |= {f"bad-{k}{i}": ", ".join(r.choice(few) for _ in range(150)) for i in range(3)}
    scored = {x.id: x for x in score_pages(spark, spark.createDataFrame(list(pages.items()), "id string, body string")).collect()}
    flagged = {k for k, v in scored.items() if v.flagged}
    assert {k for k in pages if k.startswith("bad-")} == flagged
    assert all(scored[k].cause == "curve" and scored[k].z_divergence is None for k in flagged)


def test_few_checkpoints_and_no_python_workers(spark, small, monkeypatch):
    """Executors start processes for each file of a checkpoint, and Python workers for rows that come from Python lists."""
    kept, plans, plain = [], [], spam.cut
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()

    def cut(df):
        kept.append(df)
        plans.append(plan(df))
        return plain(df)

    for module in (boilerplate, spam):
        monkeypatch.setattr(module, "cut", cut)
    plans.append(plan(queries.p3_found(spark, small)))
    assert len(kept) <= 5  # sites, lexicon, labels, pages, figures
    assert not [p for p in plans if "LogicalRDD [word#" in p or "LogicalRDD [language#" in p]
