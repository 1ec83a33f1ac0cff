import os

import numpy as np
import pandas as pd
import pytest

from tracegrid.llm import digest as dg
from tracegrid.llm.mixing import BUCKETS, _weighted, mix_sources, mixture_report, plan_mixture, with_bucket
from tracegrid.llm.packing import SquaresPacker, pack_documents, packing_report
from tracegrid.llm.reading import FEATURES, Words, features, fit_ordinal, prose, reading_levels
from tracegrid.llm.tokens import TOKENIZERS, encoder

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no public vocabulary here")
DOCS = "doc_id bigint, text string, source string, tokens bigint, n_chars bigint, weight double, container string, bucket int"
EASY = "The cat is soft. The dog runs to the hill. Now we sit in the sun. The boys jump by the cow. It has a red hat. You can see the barn. At night the birds sleep. The wind is cold. "
HARD = "Notwithstanding repeated endeavours by quantitative palaeoclimatologists, neither methodological heterogeneity nor its ostensibly morphological counterpart adequately accommodates asymmetrical institutional incentives, albeit with significant terminological qualifications. "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5, "x", 1) for i, t, s in rows], DOCS)


# ---- percentiles


@pytest.mark.parametrize("n", [1, 2, 50, 3000, 100_000])
def test_digest_rank_error(n):
    x = np.sort(np.random.default_rng(n).lognormal(0, 3, n))
    _, m, w = dg.cluster(x, np.ones(n), np.zeros(n, np.int64))
    assert len(m) <= dg.COMPRESSION + 4 and w.sum() == n and m[0] == x[0] and m[-1] == x[-1]
    for q in dg.PERCENTILES:
        e = dg.quantile(m, w, q, x[0], x[-1])
        assert abs(np.searchsorted(x, e) / n - q) <= max(2 / n, 4 * np.pi / dg.COMPRESSION * np.sqrt(q * (1 - q)))


def test_digest_of_equal_values_is_exact():
    x = np.repeat([0.1, 0.1 + 1e-17, 0.3], 3000)
    _, m, _ = dg.cluster(x, np.ones(len(x)), np.zeros(len(x), np.int64))
    assert set(m) <= {0.1, 0.3} or all(0.1 < v < 0.3 for v in set(m) - {0.1, 0.3})


def percentiles_by_hand(pdf, keys):
    return {k: np.sort(g.value.to_numpy()) for k, g in pdf.groupby(keys, dropna=False)}


def test_certified_percentiles(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": r.choice(["hot", "b", "c"], 30_000, p=[0.9, 0.09, 0.01]), "value": r.gamma(2, 5, 30_000).round(2), "n": 1})
    df = spark.createDataFrame(pdf).repartition(6).unionByName(spark.createDataFrame([("hot", None, 1), ("hot", float("nan"), 1), ("none", None, 1), ("b", float("inf"), 1)], "k string, value double, n bigint"))
    out = dg.certified_percentiles(df, ["k"]).collect()
    exact = percentiles_by_hand(pdf, "k")
    assert {x.k for x in out} == {"hot", "b", "c"} and len(out) == 3 * len(dg.PERCENTILES)
    for x in out:
        v = exact[x.k]
        lo, hi = np.searchsorted(v, x.estimate, "left"), np.searchsorted(v, x.estimate, "right")
        true = max(lo - x.percentile * len(v), x.percentile * len(v) - hi, 0) / len(v)
        assert x.n == len(v) and x.rank_error == pytest.approx(true) and x.rank_error <= x.bound
    assert dg.certified_percentiles(df.limit(0), ["k"]).count() == 0


def test_digests_of_parts_make_that_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(dg, "SLICE", 500)
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"day": r.choice(["a", "b", None], 20_000), "file": r.choice(list("xyz"), 20_000), "value": r.normal(size=20_000)})
    df = spark.createDataFrame(pdf, "day string, file string, value double").repartition(5)
    parts = dg.merge_digests(dg.build_digests(df, ["day", "file"]), ["day", "file"])
    assert parts.count() == 9
    for r_ in dg.read_percentiles(dg.merge_digests(parts, ["day"]), ["day"]).collect():
        v = np.sort(pdf[pdf.day.isna() if r_.day is None else pdf.day == r_.day].value)
        assert r_.n == len(v)
        for p, e, b in zip(dg.PERCENTILES, r_.estimates, r_.bounds, strict=True):
            assert abs(np.searchsorted(v, e) / len(v) - p) <= b


def test_readings_count_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [("f", 1, i, v, "c") for i, v in enumerate([1.0, 2.0, None, 4.0])]
    s = spark.createDataFrame(rows + rows[:2], "file string, channel_id bigint, sample_index bigint, value double, channel string")
    for size in (1 << 19, 2):
        monkeypatch.setattr(dg, "SLICE", size)
        b = dg.sorted_blocks(dg.in_order(s.unionByName(s.where("value = 4").withColumn("sample_index", F.lit(None).cast("bigint"))), "file", "channel"), ["file", "channel"], delivered=True)
        assert sorted(x for r in b.where("part is not null").collect() for x in r.part) == [1, 2, 4, 4]
    t = dg.telemetry_percentiles(s, spark.createDataFrame([("f", "2024-01-01"), ("f", "2024-01-01"), (None, "x")], "file string, day string")).collect()
    assert {(x.grouping, x.n) for x in t} == {("file_channel", 3), ("channel", 3), ("day", 3)} and {x.day for x in t if x.grouping == "day"} == {"2024-01-01"}


# ---- packing


def test_squares_packer_against_its_definition():
    r = np.random.default_rng(3)
    p, fills = SquaresPacker(20), []
    for s in r.integers(1, 21, 400).tolist():
        count = np.bincount([f for f in fills if f < 20], minlength=21)

        def cost(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + s < 20:
                c[h + s] += 1
            return int((c**2).sum())  # noqa: B023

        options = [0] + [h for h in range(1, 21 - s) if count[h]]
        box, level = p.place(s)
        assert cost(level) == min(map(cost, options)) and (box == len(fills) if level == 0 else fills[box] == level)
        if level == 0:
            fills.append(s)
        else:
            fills[box] += s
    assert max(fills) <= 20 and sum(fills) / (20 * len(fills)) > 0.95


def test_pack_documents(spark):
    text = ["word " * n for n in (1, 3, 3, 7, 10, 11, 25, 600)]
    d = docs(spark, [*enumerate_docs(text), (100, "", "s"), (101, None, "s"), (None, "word", "s"), (1, text[1], "s")])
    sizes = spark.createDataFrame([("small", 10, 1), ("large", 64, 1), ("small", 10, 1), (None, 5, 1), ("bad", 0, 1), ("none", None, 1)], "container string, capacity_tokens bigint, doc_id int")
    tokens = {i: len(encoder().encode_ordinary(t)) for i, t in enumerate(text)}
    for shard in (3, 100_000):
        rows = pack_documents(d, sizes, shard=shard).collect()
        for name, cap in (("small", 10), ("large", 64)):
            own = [r for r in rows if r.container == name]
            assert {i: sum(r.tokens for r in own if r.doc_id == i) for i in tokens} == tokens
            bins: dict = {}
            for r in own:
                bins.setdefault(r.bin, []).append((r.at, r.tokens))
            for b in bins.values():
                b.sort()
                assert sum(t for _, t in b) <= cap and all(a + t <= c for (a, t), (c, _) in zip(b, b[1:], strict=False))
            assert all((tokens[i] > cap) == (sum(r.doc_id == i for r in own) > 1) for i in tokens)
    rep = {r.container: r for r in packing_report(pack_documents(d, sizes), sizes.where("container in ('small', 'large')")).collect()}
    assert rep["large"].documents == 8 and rep["large"].tokens == sum(tokens.values()) and 0 < rep["small"].used_share <= 1
    assert pack_documents(d.limit(0), sizes).count() == 0 == pack_documents(d, sizes.limit(0)).count()


def enumerate_docs(texts, source="s"):
    return [(i, t, source) for i, t in enumerate(texts)]


# ---- mixing

TARGETS = "source string, target_share double, max_repeats int, tokens bigint"


def test_mixture(spark):
    rows = [(i, "some words here " * (1 + i % 5), "Main_Dump" if i % 3 else " main-dump") for i in range(400)] + [(1000 + i, "small text " * 4, "tiny") for i in range(20)] + [(2000 + i, "x", "other") for i in range(50)] + [(3000, None, "tiny"), (3001, "a", None), (0, "some words here ", " main-dump")]
    d = docs(spark, rows)
    t = spark.createDataFrame([("main dump".replace(" ", "_"), 0.6, 1, 1), ("tiny", 0.3, 4, 1), ("absent", 0.1, 2, 1), (None, 0.5, 1, 1), ("zero", 0.0, 1, 1)], TARGETS)
    mix = mix_sources(d, t)
    got = mix.collect()
    assert {r.source for r in got} == {"maindump", "tiny"} and len({r.doc_id for r in got}) == len(got)
    assert all(r.repeats == 4 for r in got if r.source == "tiny") and all(r.repeats == 1 for r in got if r.source == "maindump")
    rep = {r.source: r for r in mixture_report(mix, t).collect()}
    assert rep["absent"].reached_share == 0 and rep["tiny"].reached_share == pytest.approx(1 / 3, abs=0.02) and rep["main_dump"].reached_share == pytest.approx(2 / 3, abs=0.02)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(d.repartition(7), t).collect()))
    assert mix_sources(d.limit(0), t).count() == 0 == mix_sources(d, t.limit(0)).count()


def test_plan_has_complete_epochs_first(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100)], "source string, t bigint")
    plan = {p["source"]: p for p in plan_mixture(totals, spark.createDataFrame([("a", 0.75, 1, 1), ("B ", 0.25, 3, 1)], TARGETS))}
    assert plan["b"]["epochs"] == 3 and plan["b"]["rest"] == 0 and plan["a"]["epochs"] == 0 and plan["a"]["rest"] == pytest.approx(900)


def test_buckets_are_of_equal_depth_whatever_the_weights(spark):
    from pyspark.sql import functions as F

    for weight in ("1.0", "0.1", "if(id % 3 = 0, 1.0, 0.1)"):
        u = (F.pmod(F.xxhash64("id"), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
        d = spark.range(60_000).select(F.lit("s").alias("source"), "id", (-F.log(u) / F.expr(weight)).alias("key"))
        b = with_bucket(d)
        n = [r[1] for r in b.groupBy("bucket").count().collect()]
        assert len(n) > 0.9 * BUCKETS and max(n) < 3 * 60_000 / BUCKETS
        lo = {r.bucket: (r.a, r.z) for r in b.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).collect()}
        assert all(lo[i][1] <= lo[j][0] for i, j in zip(sorted(lo), sorted(lo)[1:], strict=False))


def test_the_sample_is_the_prefix_of_the_keys(spark):
    # Against brute force: the documents in the order of their keys, up to the budget.
    import math

    from pyspark.sql import functions as F

    rows = [(i, "the people of the village walk to the river " * (1 + i % 7), "m") for i in range(500)] + [(5000, "word " * 9000, "lim")]
    t = spark.createDataFrame([("m", 0.8, 1, 1), ("lim", 0.2, 1, 1)], TARGETS)
    d = docs(spark, rows)
    w = {r.doc_id: r for r in _weighted(d, TOKENIZERS).where("source = 'm'").select("*", F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(2**52)).alias("u")).collect()}
    order = sorted(w, key=lambda i: (-math.log((w[i].u + 0.5) / 2**52) / w[i].weight, i))
    have = {"m": sum(r.tokens for r in w.values()), "lim": len(encoder().encode_ordinary(rows[-1][1]))}
    size = min(have["m"] / 0.8, have["lim"] / 0.2)
    rest, upto, taken = 0.8 * size, 0, set()
    for i in order:
        if upto + w[i].tokens / 2 <= rest:
            taken.add(i)
        upto += w[i].tokens
    got = {r.doc_id for r in mix_sources(d, t).where("source = 'm'").collect()}
    assert got == (taken if rest < have["m"] else set(w))


def test_sampling_follows_the_weights(spark):
    # Prose has more characters a token than digits, hence the larger weight.
    rows = [(i, "the people of the village walk to the river " * 3, "m") for i in range(300)] + [(1000 + i, "83 92 17 55 2 9 1 4 7 3 8 1 9 9 2 8 4 0 1 3 5 9 2 7 1 6 4 8", "m") for i in range(300)] + [(5000, "word " * 2000, "lim")]
    t = spark.createDataFrame([("m", 0.8, 1, 1), ("lim", 0.2, 1, 1)], TARGETS)
    got = mix_sources(docs(spark, rows), t).where("source = 'm'").select("doc_id").collect()
    prose_docs = sum(r.doc_id < 1000 for r in got)
    assert 0 < len(got) < 600 and prose_docs > 1.5 * (len(got) - prose_docs)


# ---- reading level


def test_prose_is_told_from_markup():
    t = "{{Infobox x|a={{b|c}}|d={{{e|}}}}}\n'''Name''' is a [[town|place]] of note.<ref name=\"a\" /> It has &#91;&#91;File:x.png]] two halls.<!-- no -->\r\n{| class=\"w\"\n! a !! b\n|-\n| c || d. e.\n|}\n* a list. of things.\n== Head ==\n[[Category:Towns]]\n[[de:Name]]\nlol hi mum!!! NOBODY READS THIS. Old walls stand.{{cite|x}}\n{{unclosed. text"
    assert prose(t)[:3] == ["Name is a place of note.", "It has  two halls.", "lol hi mum!!!"]
    n, english, _ = features(t, Words())
    assert n == 3 and english > 0.9
    assert prose("#REDIRECT [[X]]") == [] == prose("") == prose(None) == prose("  #redirect [[x]]")
    assert features("x" * 300_000, Words())[0] == 0 and features("aaaa bbbb cccc. " * 20_000, Words())[0] == 0


def passages(spark):
    r = np.random.default_rng(4)
    mid = ["The council opened a small office near the bridge, which served the town after the war.", "Although costs were high, the railway remained in use until the line was closed.", "Many visitors came to the market because the road was repaired in the same year."]
    rows = []
    for i in range(8):
        rows += [(i, 1, " ".join(r.permutation(EASY.split(". "))[:6]).replace(" .", ".") + "."), (i, 2, " ".join(r.permutation(mid)) + " " + mid[0]), (i, 3, HARD * 2)]
        rows[-3] = (i, 1, ". ".join(r.permutation([x for x in EASY.strip().rstrip(".").split(". ")])) + ".")
    return spark.createDataFrame([(a, b, c, 9) for a, b, c in rows], "passage_id bigint, level int, text string, doc_id int"), mid


def test_reading_levels(spark):
    graded, mid = passages(spark)
    d = docs(spark, [
        (1, EASY, "s"), (2, " ".join(mid * 3), "s"), (3, HARD * 7, "s"), (4, "Le village est un lieu calme et le marché reste très petit pour les marchands. " * 8, "s"), (5, " ".join(mid), "s"), (6, "", "s"), (7, None, "s"), (None, EASY, "s"),
        (8, "#REDIRECT [[A]]", "s"), (9, "NOBODY READS THIS. " * 9, "s"), (10, "lol! " + EASY + "BANANA BANANA BANANA!", "s"), (11, "'''" + EASY.replace(". ", "''' .\n* "), "s"), (1, EASY, "s"), (12, HARD * 3000, "s"),
    ])
    got = {r.doc_id: r.level for r in reading_levels(d, graded).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 10: 1, 12: 3}
    assert reading_levels(d.limit(0), graded).count() == 0
    with pytest.raises(ValueError, match="two levels"):
        reading_levels(d, graded.where("level = 1"))


def test_ordinal_regression_on_held_out_rows():
    r = np.random.default_rng(5)
    y = r.integers(1, 6, 400)
    x = y[:, None] * r.uniform(0.5, 2, len(FEATURES)) + r.normal(0, 0.6, (400, len(FEATURES)))
    m = fit_ordinal(x[:300], y[:300])
    assert (np.diff(m.cuts) > 0).all() and (m.predict(x[300:]) == y[300:]).mean() > 0.9 and np.abs(m.predict(x[300:]) - y[300:]).max() <= 1


def test_queries_are_registered(spark):
    from tracegrid.llm import queries

    assert [k[:2] for k in queries.QUERIES] == ["p2", "p2", "p7", "p7", "p8", "p8", "p9"]


def test_nested_markup_goes_in_one_pass():
    # As taking off the innermost layer again and again would, at any depth.
    from tracegrid.llm import reading as rd

    def layers(t, pattern):
        n = 1
        while n:
            t, n = pattern.subn("", t)
        return t

    r = np.random.default_rng(7)

    def nested(depth, pairs):
        parts = []
        for _ in range(r.integers(1, 4)):
            o, c = pairs[r.integers(len(pairs))]
            parts += [r.choice(["a", " b", "c\n", ""]), o + (nested(depth - 1, pairs) if depth else "x") + c]
        return "".join(parts) + r.choice(["", "end."])

    for pairs, pattern, once in (([("{{", "}}"), ("{{{", "}}}")], rd._TEMPLATE, rd._without_templates), ([("{|", "|}")], rd._TABLE, rd._without_tables)):
        for _ in range(200):
            t = nested(int(r.integers(0, 6)), pairs)
            assert layers(t, pattern) == once(t), t
    deep = "{{a " * 200_000 + "x" + "}}" * 200_000 + " The old walls stand."
    assert prose(deep) == ["The old walls stand."] and prose("{|" * 100_000 + " x" + "|}" * 100_000 + " The old walls stand.") == ["The old walls stand."]
