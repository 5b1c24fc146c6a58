import pytest

from wharfside.llm import mixing

pytest.importorskip("tokenizers")


def test_text_of_several_sources(spark):
    rows = [(i, f"alpha beta gamma {i}", "a") for i in range(20)] + [(100 + i, f"red green blue {i}", "b") for i in range(20)]
    rows += [(30, "shared text one", "z"), (50, "shared text one", "a"), (200, "shared text one", "b"), (31, "only unnamed", "z")]
    documents = spark.createDataFrame([(1000 + i, t, s) for i, t, s in rows], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("ma", "a", 1.0, 1), ("mb", "b", 1.0, 1), ("both", "a", 0.5, 1), ("both", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing._members(documents, mixing._classifier(documents, ["a", "b"], 100), mixing.TOKENIZER, 8)
    shared = members.filter("at IS NOT NULL").collect()
    assert [(r.doc_id, r.source, r["at"], r.grp) for r in shared] == [(1030, "a", [1050, 1200], "")] and members.count() == 41
    mixes = [mixing.Mix(n, mixing.np.array(s), mixing.np.array(s)) for n, s in (("ma", [1.0, 0.0]), ("mb", [0.0, 1.0]), ("both", [0.5, 0.5]))]
    wide = mixing._in_mixes(members, mixes, ["a", "b"])
    got = {(r.mix_name, r.source, r.doc_id) for r in wide.filter("doc_id IN (1030, 1050, 1200)").collect()}
    assert got == {("ma", "a", 1050), ("mb", "b", 1200), ("both", "a", 1050)}
    assert wide.groupBy("mix_name").count().collect() and {r.source for r in wide.filter("mix_name = 'ma'").collect()} == {"a"}
    mixed = mixing.mix_sources(documents, targets).collect()
    assert all(r.repeats == 1 for r in mixed) and len({(r.mix_name, r.doc_id) for r in mixed}) == len(mixed)
    assert sum(r.n_tokens for r in mixed if r.mix_name == "mb") >= 0.9 * sum(r.n_tokens for r in members.collect() if r.source == "b" or r["at"])


def test_fit_and_rounding():
    """The fit meets the targets exactly where stock allows, with rates inside their limits, and tells how it ended."""
    np = mixing.np
    mix = mixing.Mix("m", np.array([0.5, 0.3, 0.2]), np.array([2.0, 2.0, 3.0]))
    own = np.array([0, 1, 2, 0, 1])
    membership = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.25, 0.25], [0.25, 0.75, 0]])
    tokens = np.array([5000.0, 4000.0, 900.0, 50.0, 30.0])
    rates = mixing._fit(mix, own, membership, tokens, None)
    assert (rates >= 0).all() and (rates <= mix.limit[own] + 1e-12).all() and mix.residual < 1e-6 and mix.steps > 0
    assert np.allclose((tokens * rates) @ membership, mix.share * mix.size, rtol=1e-5)
    partly = mixing.Mix("p", np.array([0.5, 0.5, 0.0]), np.array([1.0, 1.0, 0.0]))
    rates = mixing._fit(partly, own, membership, tokens, None)
    assert rates[2] == rates[3] == 0 and rates[4] > 0
    assert mixing._fit(mixing.Mix("n", np.array([0.5, 0.5]), np.array([1.0, 1.0])), np.array([0]), np.eye(2)[:1], np.array([9.0]), None).tolist() == [0.0]  # a source without texts
    for grid in (1, 2, 8):
        p = mixing._rounded(np.array([0.5, 0.3, 0.15, 0.05]), grid)
        assert sum(p) == grid and p[0] == max(p)
    assert mixing._grid(8) == 8 and mixing._grid(300) == 2 and mixing._grid(700) == 1


def test_invariants_and_rare_sources(spark):
    rows = [(i, " ".join(["alpha beta gamma"] * (i % 7 + 1)) + f" {i}", "a") for i in range(400)]
    rows += [(500 + i, " ".join(["red green blue"] * (i % 5 + 1)) + f" {i}", "b" if i < 6 else None) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model = mixing._classifier(documents, ["a", "b"], 20)  # a source with few rows has its part of the labels
    assert model.posterior("red green blue red")[1] > 0.5 > model.posterior("alpha gamma")[1]
    targets = spark.createDataFrame([("m", "a", 0.6, 2), ("m", "b", 0.4, 2)], "mix_name string, source string, target_share double, max_repeats int")
    plan = mixing.plan_mix(documents, targets)
    mixed = mixing.write_table(plan.texts(), "m")
    assert [tuple(r) for r in mixing.mix_invariants(mixed, documents, targets, within=0.02).collect()] == [("m", True, True, True, True)]
    shares = {r.source: r for r in mixing.mix_shares(mixed, targets).collect()}
    assert abs(shares["b"].expected_share - 0.4) < 0.02 and mixed.filter("membership IS NOT NULL").count() > 20
    assert plan.report().first().residual < 1e-5
