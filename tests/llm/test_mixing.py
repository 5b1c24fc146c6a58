import random

import pytest

from wharfside.llm import mixing

pytest.importorskip("tokenizers")


def _documents(spark, n=600):
    rng = random.Random(1)
    words = {"a": "alpha beta gamma delta", "b": "red green blue grey", "c": "one two three four"}
    rows = []
    for i in range(n):
        s = rng.choices("abc", [6, 3, 1])[0]
        text = " ".join(rng.choices(words[s].split(), k=rng.randint(5, 40))) + f" {i}"
        rows.append((i, text, s if rng.random() > 0.15 else rng.choice([None, " "]), s))
    rows += [(n + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(min(50, n))] + [(9000, None, "a", "a"), (9001, "", "b", "b"), (9002, "other text", "unnamed", "x"), (None, "no id", "a", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, repeats string"), {i: s for i, _, _, s in rows}


def test_mix(spark):
    documents, truth = _documents(spark)
    targets = spark.createDataFrame(
        [("m1", "a", 0.5, 2), ("m1", "b", 0.3, 2), ("m1", "c", 0.2, 3), ("m2", "a", 1.0, 1), ("m2", "b", None, 1), ("m3", "b", 0.5, 2), ("m3", "zz", 0.5, 2), (None, "a", 1.0, 1)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    mixed = mixing.write_table(mixing.mix_sources(documents, targets), "m")
    rows = mixed.collect()
    assert {r.mix_name for r in rows} <= {"m1", "m2", "m3"}
    limit = {"a": 2, "b": 2, "c": 3}
    m1 = [r for r in rows if r.mix_name == "m1"]
    assert all(1 <= r.repeats <= limit[r.source] for r in m1) and len({r.doc_id for r in m1}) == len(m1)
    assert all(r.doc_id < 600 for r in m1)  # repeated texts are one text
    assert sum(truth[r.doc_id] != r.source for r in m1) <= 0.02 * len(m1)
    total = sum(r.n_tokens * r.repeats for r in m1)
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.n_tokens * r.repeats for r in m1 if r.source == source) / total - share) < 0.03
    assert sum(r.repeats for r in m1 if r.source == "c") >= 2.5 * sum(1 for r in m1 if r.source == "c")  # the scarce source is used up
    m2 = [r for r in rows if r.mix_name == "m2"]
    assert {r.source for r in m2} == {"a"} and all(r.repeats == 1 for r in m2)
    shares = {(r.mix_name, r.source): r for r in mixing.mix_shares(mixed, targets.filter("mix_name = 'm1'")).collect()}
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    sized = mixing.mix_sources(documents, targets.filter("mix_name = 'm1'"), total=1500)
    assert abs(sum(r.n_tokens * r.repeats for r in sized.collect()) - 1500) < 150


def test_empty(spark):
    documents, _ = _documents(spark, 5)
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert mixing.mix_sources(documents, targets.limit(0)).count() == 0
    assert mixing.mix_sources(documents.limit(0), targets).count() == 0
