import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logrung.operators import templates as tp
from logrung.operators.template_mining import Bounds
from logrung.operators import tokens as tk


def messages(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, masked string")


def test_mining_merges_similar_messages(spark):
    df = messages(spark, *[f"user {n} logged in from <IP>" for n in ("ann", "bob", "cat")], "disk full on <NUM>", "", "disk full on <NUM>")
    got = {r.template: r for r in tp.mine_templates(df).collect()}
    assert set(got) == {"user <*> logged in from <IP>", "disk full on <NUM>"}
    assert (got["user <*> logged in from <IP>"].messages, got["user <*> logged in from <IP>"].rows) == (3, 3)
    assert got["disk full on <NUM>"].rows == 2 and got["disk full on <NUM>"].is_new
    totals = tp.template_totals(tp.mine_templates(df)).first()
    assert (totals.messages, totals.templates) == (5, 2)


def test_first_tokens_with_digits_share_a_branch(spark):
    df = messages(spark, *[f"x{n} stopped cleanly today" for n in range(5)])
    assert [r.template for r in tp.mine_templates(df).collect()] == ["<*> stopped cleanly today"]


def test_order_and_partitions_do_not_matter(spark):
    texts = [f"job {a} step {b} of {c} ended" for a in "abc" for b in "de" for c in "fghi"] + [f"{w} went down" for w in "pqrst"]
    one = {tuple(r) for r in tp.mine_templates(messages(spark, *texts)).collect()}
    two = {tuple(r) for r in tp.mine_templates(messages(spark, *reversed(texts)).repartition(5)).collect()}
    assert one == two


SMALL = (
    Bounds(first_open=1, most_open=1, slice_rows=5, pairs=2, most_tasks=3),
    Bounds(first_open=2, most_open=5, slice_rows=7, pairs=11, most_tasks=5),
    Bounds(first_open=3, most_open=100, slice_rows=4, pairs=1, most_tasks=2),
)


@pytest.mark.parametrize("bounds", SMALL)
def test_large_leaves_are_split_and_nothing_is_lost(spark, bounds):
    texts = [f"same start {a} {b} end" for a in "abcdef" for b in "ghij"]
    df = messages(spark, *texts)
    mined = tp.mine_templates(df, bounds=bounds)
    assert mined.agg(F.sum("messages"), F.sum("rows")).first()[:] == (24, 24)
    covered = tp.template_coverage(tp.match_templates(df, mined)).first()
    assert (covered.matched, covered.unmatched) == (24, 0)


def test_rare_first_tokens_share_a_branch(spark):
    texts = [f"{w} is gone now" for w in "abcdefghij"] + ["often is gone now"] * 5
    mined = tp.mine_templates(messages(spark, *texts), max_children=2)
    got = {r.template: r.rows for r in mined.collect()}
    assert got == {"often is gone now": 5, "<*> is gone now": 10}


def test_training_continues(spark):
    first = tp.mine_templates(messages(spark, "a b c d", "a b c e"))
    more = tp.mine_templates(messages(spark, "a b c f", "other thing here"), stored=first)
    got = {r.template: (r.rows, r.is_new) for r in more.collect()}
    assert got == {"a b c <*>": (3, False), "other thing here": (1, True)}


def test_match_prefers_fewest_wildcards_then_the_smaller_id(spark):
    known = spark.createDataFrame(
        [(5, "a <*> c"), (4, "<*> b c"), (3, "a b <*>"), (9, "a b c"), (1, "<*> <*> <*>"), (2, "x")],
        "template_id long, template string",
    )
    df = messages(spark, "a b c", "z b c", "a  b\tz", "q q q", "y", "")
    got = {r.id: (r.template, r.matched) for r in tp.match_templates(df, known).collect()}
    assert got[0] == ("a b c", True)
    assert got[1] == ("<*> b c", True)
    assert got[2] == ("a b <*>", True)
    assert got[3] == ("<*> <*> <*>", True)
    assert got[4] == ("<UNKNOWN_FORMAT>", False) and got[5] == ("<UNKNOWN_FORMAT>", False)


def test_tokens(spark):
    df = spark.createDataFrame([("<IP> a <NUM>",), ("<NUM> b",), (None,), ("",)], "text string")
    assert [r.token for r in tk.token_vocabulary(df).collect()] == ["<IP>", "<NUM>"]
    known = spark.createDataFrame([("<NUM>",)], "token string")
    grown, added = tk.register_tokens(known, tk.token_vocabulary(df))
    assert added == 1 and grown.count() == 2
    words = tk.tokenize(spark.createDataFrame([("<IP>  A b\tc",)], "text string"), limit=3).first().words
    assert words == ["<IP>", "A", "b"]


def test_leaf_size_and_copies_of_the_corpus_do_not_alter_templates(spark):
    texts = [f"same start {a} {b} {c} end" for a in "abcde" for b in "ghi" for c in "klmn"]
    df = messages(spark, *texts)
    whole = {tuple(r) for r in tp.mine_templates(df).collect()}
    assert {r[1] for r in whole} == {"same start <*> <*> <*> end"}
    for bounds in SMALL[1:]:
        assert {tuple(r) for r in tp.mine_templates(df, bounds=bounds).collect()} == whole
    tenfold = {r.template for r in tp.mine_templates(messages(spark, *texts * 10), bounds=SMALL[1]).collect()}
    assert tenfold == {r[1] for r in whole}


def _similar(a, b, need):
    return sum(x == y and y != "<*>" for x, y in zip(a, b, strict=True)) >= need


def _slow_mine(weights, stored=(), need_of=lambda w: max(1, -(-2 * w // 5))):
    """Templates of messages of one leaf, by its definition: {template: (messages, rows, is_new)}."""
    found = {}
    pool, leaders = dict(weights), [(t.split(" "), True) for t in stored]
    while pool:
        order = sorted(pool, key=lambda t: (-pool[t], t))
        need = need_of(len(order[0].split(" ")))
        for t in order:
            words = t.split(" ")
            if not any(_similar(words, k, need) for k, _ in leaders):
                leaders.append((words, False))
        members = {}
        for t in order:
            words = t.split(" ")
            same = [sum(x == y and not (old and y == "<*>") for x, y in zip(words, k, strict=True)) for k, old in leaders]
            best = max(range(len(leaders)), key=lambda i: (same[i], -i))
            mask = tuple(x == y and y != "<*>" for x, y in zip(words, leaders[best][0], strict=True))
            members.setdefault(best, {}).setdefault(mask, []).append(t)
        back = {}
        for best, by_mask in members.items():
            words, old = leaders[best]
            fixed, taken = tuple(w != "<*>" for w in words), []
            for mask in sorted(by_mask, key=lambda m: (sum(pool[t] for t in by_mask[m]), m), reverse=True):
                left = tuple(a and b for a, b in zip(fixed, mask, strict=True))
                if left == fixed or sum(left) >= need:
                    fixed, taken = left, taken + by_mask[mask]
                else:
                    back |= {t: pool[t] for t in by_mask[mask]}
            name = " ".join(w if f else "<*>" for w, f in zip(words, fixed, strict=True))
            n, rows, new = found.get(name, (0, 0, True))
            found[name] = (n + len(taken), rows + sum(pool[t] for t in taken), new and not old)
        pool, leaders = back, []
    return found


@pytest.mark.parametrize("seed", range(3))
def test_mining_against_its_definition(spark, seed):
    rng = random.Random(seed)
    width, words = [(5, 3), (3, 8), (10, 2)][seed]
    texts = ["in " + " ".join(rng.choice("abcdefgh"[:words]) + str(i) for i in range(width - 1)) for _ in range(120)]
    weights = Counter(texts)
    df = messages(spark, *texts)
    want = _slow_mine(weights)
    for bounds in (None, Bounds(first_open=30, most_open=100, slice_rows=40, pairs=50)):
        got = {r.template: (r.messages, r["rows"], r.is_new) for r in tp.mine_templates(df, bounds=bounds).collect()}
        assert got == want


def test_many_unlike_messages_of_one_leaf(spark):
    df = spark.range(60_000).select(
        F.concat(F.lit("unit "), F.concat_ws(" ", *[F.concat(F.lit(c), F.hash("id", F.lit(c)).cast("string")) for c in "bcdefg"]), F.lit(" stopped")).alias("masked")
    )
    mined = tp.mine_templates(df, bounds=Bounds(first_open=8_000, slice_rows=10_000)).agg(F.count("*"), F.sum("messages")).first()
    assert mined[:] == (60_000, 60_000)


def test_literal_wildcards_in_messages(spark):
    df = messages(spark, "<*>", "<*> <*>", "a <*> b", "a <*> c", "<*> x <*>")
    mined = tp.mine_templates(df)
    assert mined.agg(F.sum("messages")).first()[0] == 5
    covered = tp.template_coverage(tp.match_templates(df, mined)).first()
    assert covered.unmatched == 0


def test_stored_templates_take_what_fits_and_grow(spark):
    stored = spark.createDataFrame(
        [("<*> is gone now", 4), ("job a of b c", 2), ("never seen here", 9)], "template string, rows long"
    )
    df = messages(spark, "alpha is gone now", "alpha is gone now", "job a of x y", "beta is gone now", "quite another line of words")
    for bounds in (None, SMALL[0]):
        got = {r.template: (r.messages, r["rows"], r.is_new) for r in tp.mine_templates(df, stored=stored, bounds=bounds).collect()}
        assert got == {
            "<*> is gone now": (2, 7, False),
            "job a of <*> <*>": (1, 3, False),
            "never seen here": (0, 9, False),
            "quite another line of words": (1, 1, True),
        }


def test_matching_against_all_pairs(spark):
    rng = random.Random(11)
    tokens = ["a", "b", "c", "<*>", "<NUM>"]
    known = {(i, " ".join(rng.choices(tokens, k=rng.randint(1, 5)))) for i in range(120)} | {(500, "<*> <*>"), (501, "<*>")}
    texts = [" ".join(rng.choices(["a", "b", "c", "<NUM>", "d"], k=rng.randint(1, 6))) for _ in range(400)]
    df = messages(spark, *texts)
    got = {r.id: r.template_id for r in tp.match_templates(df, spark.createDataFrame(list(known), "template_id long, template string")).collect()}

    def slow(text):
        words = text.split(" ")
        hits = [
            (t.split(" ").count("<*>"), i)
            for i, t in known
            if len(t.split(" ")) == len(words) and all(x in ("<*>", w) for x, w in zip(t.split(" "), words, strict=True))
        ]
        return min(hits)[1] if hits else None

    assert got == {i: slow(t) for i, t in enumerate(texts)}


def test_probes_are_no_more_than_tokens(spark):
    known = spark.createDataFrame([(i, " ".join("<*>" if i >> k & 1 else f"w{k}" for k in range(10))) for i in range(1024)], "template_id long, template string")
    text = " ".join(f"w{k}" for k in range(10))
    best = tp.match_messages(spark.createDataFrame([(text, 1)], "text string, rows long"), known).collect()
    assert [(r.text, r.template_id) for r in best] == [(text, 0)]
