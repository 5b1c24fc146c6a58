import random
from collections import Counter, defaultdict

import pytest

from wharfside.llm import packing
from wharfside.llm.tokens import TOKENIZER, token_counts

pytest.importorskip("tokenizers")


def _contents(plan):
    fill, given = defaultdict(list), defaultdict(list)
    for length, first, items, container, each in plan.rules:
        assert items > 0 and items % each == 0
        given[length].append((first, items))
        for k in range(items):
            fill[container + k // each].append(length)
    return fill, given


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 100, 512])
    counts = Counter(min(capacity, max(1, int(rng.lognormvariate(3, 1.2)))) for _ in range(rng.choice([1, 10, 500, 5000])))
    plan = packing.plan_packing(dict(counts), capacity)
    fill, given = _contents(plan)
    assert set(fill) == set(range(1, plan.containers + 1))
    assert all(sum(v) <= capacity for v in fill.values())
    assert Counter(x for v in fill.values() for x in v) == counts
    for parts in given.values():  # the items of a length are dealt out without gap or overlap
        at = 1
        for first, n in sorted(parts):
            assert first == at
            at += n
    half_empty = sum(1 for v in fill.values() if sum(v) * 2 <= capacity)
    assert half_empty <= 1  # as of any best-fit packing


def test_exact_complements_are_used():
    plan = packing.plan_packing({60: 3, 40: 1, 30: 1, 10: 1, 20: 2}, 100)
    fill, _ = _contents(plan)
    assert plan.containers == 3 and sorted(map(sum, fill.values())) == [100, 100, 100]


def test_pack_texts(spark):
    texts = ["one two three", "one two three", "", None, " ", "word " * 300, "日本語のテキスト " * 40, "a"] + [f"text {i} " * (i % 7 + 1) for i in range(60)]
    documents = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, capacity_id int")
    capacities = spark.createDataFrame([(1, 16), (2, 64), (2, 70), (3, None), (None, 5), (4, 0)], "capacity_id int, capacity_tokens int")
    sizes = token_counts(texts, TOKENIZER)
    got = packing.pack_texts(documents, capacities).collect()
    for capacity, room in ((1, 16), (2, 64)):
        mine = [r for r in got if r.capacity_id == capacity]
        fill, parts = Counter(), defaultdict(list)
        for r in mine:
            parts[r.doc_id].append((r.piece_no, r.token_start, r.n_tokens))
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                fill[r.container_id] += r.n_tokens
        assert set(parts) == set(range(len(texts))) and max(fill.values()) <= room and set(fill) == set(range(1, max(fill) + 1))
        for doc, pieces in parts.items():
            pieces.sort()
            assert sum(n for *_, n in pieces) == sizes[doc] and (len(pieces) == 1 or sizes[doc] > room)
            assert all(n == room for *_, n in pieces[:-1]) and [p for p, *_ in pieces] == list(range(1, len(pieces) + 1))
            assert [s for _, s, _ in pieces] == [i * room for i in range(len(pieces))]
    assert {r.capacity_id for r in got} == {1, 2}
    totals = {r.capacity_id: r for r in packing.container_fill(packing.pack_texts(documents, capacities), capacities).collect()}
    assert totals[2].tokens == sum(sizes) and 0.9 < totals[2].fill <= 1
    assert packing.pack_texts(documents.limit(0), capacities).count() == 0 and packing.pack_texts(documents, capacities.limit(0)).count() == 0


def test_both_forms_of_the_tokenizer_agree():
    rng = random.Random(9)
    texts = [None, "", " ", "it's  two\n\n lines ", "x" * 3000, " " * 3000, "日本語 café — 12,345 #tag", "<|endoftext|>"]
    texts += ["".join(rng.choices("ab 1,.\n'日é", k=rng.randint(0, 200))) for _ in range(300)]
    assert token_counts(texts, TOKENIZER) == token_counts(texts, TOKENIZER.replace(".tiktoken", ".json"))
