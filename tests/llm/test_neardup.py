import math
import random
import re

import pytest

from spindrift.llm.neardup import asked_bins, classes, expand, near_duplicates


def runs(text, n):
    w = re.sub(r"[^\w\s]", "", text.lower()).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, t):
    sets = {i: s for i, x in texts.items() if x and (s := runs(x, n))}
    ids, out = sorted(sets), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= t * (len(sets[a]) + len(sets[b]) - both):
                out.add((a, b))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    phrases = [" ".join(r.choice("abcdefghij") * 2 for _ in range(6)) for _ in range(12)]  # runs that many texts share
    words = [f"w{i}" for i in range(400)]
    out = {}
    for d in range(60):
        base = [r.choice(words) if r.random() < 0.6 else r.choice(phrases) for _ in range(r.randint(5, 60))]
        out[f"d{d:03d}-0"] = " ".join(base)
        for v in range(1, r.choice([1, 2, 5])):
            edited = [x if r.random() > 0.12 * v else r.choice(words) for x in base]
            cut = r.randint(0, len(edited) // 4)
            out[f"d{d:03d}-{v}"] = " ".join(edited[cut:] + edited[: cut // 2])
    copy = "The very same text, told again and again in the same words by all of them."
    out |= {f"copy{i:02d}": copy if i % 2 else copy.upper().replace(",", "") for i in range(25)}
    out |= {"null": None, "empty": "", "blank": " \n ", "two": "two words", "short1": "one two three", "short2": "one, two three!"}
    out["long"] = " ".join(str(i % 7919) for i in range(40_000))
    out["long2"] = out["long"] + " tail end here"
    return out


@pytest.mark.parametrize(("n", "t"), [(3, 0.4), (5, 0.8)])
def test_all_pairs_are_found(spark, texts, n, t):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()] + [(None, "one two three", "x", 1)], "id string, text string, rep string, n int")
    pairs, members = near_duplicates(df, "id", "text", n, t)
    got = {(r.id_a, r.id_b) for r in expand(pairs, members, "id").collect()}
    want = brute(texts, n, t)
    assert got == want
    assert len({r.rep for r in members.collect() if r.id.startswith("copy")}) == 1
    links, leader = {}, {k: k for x in want for k in x}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    changed = True
    while changed:
        changed = False
        for a, b in want:
            low = min(leader[a], leader[b])
            changed |= leader[a] != low or leader[b] != low
            leader[a] = leader[b] = low
    out = {r.id: (r["class"], r.links) for r in classes(pairs, members, "id").collect()}
    assert {k: v[1] for k, v in out.items() if v[1]} == links
    assert all(out[k][0] == leader.get(k, k) for k in out)


def test_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, text string")
    for part in (df, df.limit(0)):
        pairs, members = near_duplicates(part, "id", "text")
        assert expand(pairs, members, "id").count() == 0 and classes(pairs, members, "id").count() == 0


def test_too_low_a_threshold(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([("a", "one two three four five")], "id string, text string"), "id", "text", threshold=0.2)


def test_own_runs_rarer_than_shared_ones(spark):
    """Pairs just above the threshold whose own runs come first among the rarest, since others have them too; few shared ones follow."""
    shared, usual, own_a, own_b = (0, 343), (103, 343), (343, 800), (800, 857)
    sets = {"a": [shared, own_a], "b": [shared, own_b], "c": [shared], "d": [own_a], "e": [own_b], "f": [usual]}
    rows = [(f"{g:03d}{k}", " ".join(f"{g}x{i}" for low, high in v for i in range(low, high))) for g in range(300) for k, v in sets.items()]
    pairs, _ = near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text", 1, 0.4)
    got = {(r.rep_a, r.rep_b) for r in pairs.collect()}
    assert got == {(f"{g:03d}{x}", f"{g:03d}{y}") for g in range(300) for x, y in ("ab", "ac", "ad", "bc", "bf", "cf")}


@pytest.mark.parametrize("how", [{"exact": True}, {"common_runs": 20, "block": 7}, {"common_runs": 0}, {"common_runs": 1, "block": 3, "exact": True}])
def test_order_blocks_and_estimate_dont_change_the_result(spark, texts, how):
    df = spark.createDataFrame([(k, v) for k, v in texts.items() if k != "long2"], "id string, text string")
    pairs, members = near_duplicates(df, "id", "text", 3, 0.4, **how)
    got = [(r.id_a, r.id_b) for r in expand(pairs, members, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute({k: v for k, v in texts.items() if k != "long2"}, 3, 0.4)


def test_bins_asked_for_are_a_bound():
    asked = asked_bins(0.4, 1e-6)
    assert asked[0] == 0 and asked == sorted(asked) and asked[128] < 0.4 * 128
    for m, q in enumerate(asked):
        assert sum(math.comb(m, i) * 0.4**i * 0.6 ** (m - i) for i in range(q)) <= 1e-6


def test_a_hot_run_in_a_third_of_all_records(spark):
    r = random.Random(3)
    texts = {f"h{i:04d}": "the same old words here " + " ".join(f"z{r.randint(0, 10**6)}" for _ in range(3)) for i in range(400)}
    texts |= {f"o{i:04d}": " ".join(f"y{r.randint(0, 10**6)}" for _ in range(9)) for i in range(800)}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    pairs, members = near_duplicates(df, "id", "text", 3, 0.4, block=50)
    assert {(x.id_a, x.id_b) for x in expand(pairs, members, "id").collect()} == brute(texts, 3, 0.4)
