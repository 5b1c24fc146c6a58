import random

from wharfside.llm import spam_pages
from wharfside.llm.prose_model import LANGUAGES, read_texts, train_on_prose

SUBJECTS = ["the server", "a client", "every page", "the old index", "this reader", "our crawler"]
VERBS = ["reads", "keeps", "sorts", "returns", "moves", "checks"]
OBJECTS = ["the answer", "a small table", "all rows of the report", "the name of a host", "what it needs", "the links"]
ENDS = ["before noon", "when the queue is empty", "because nobody asks for it", "in one pass", "and writes a note", "until the page is clean"]


def _prose(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}." for _ in range(n))


def _spam(rng, n):
    key = rng.choice(["cheap api", "travel bot", "skill pack"])
    kind = rng.randrange(4)
    if kind == 0:
        return ", ".join(f"{key} {rng.choice(['best', 'free', 'online'])}" for _ in range(n * 5))
    if kind == 1:
        return "\n".join(f"https://h{rng.randrange(99)}.example/{rng.choice('abc')}/x" for _ in range(n * 3))
    if kind == 2:
        return " ".join([key] * n * 6)
    return " ".join(f"#{rng.choice(['agents', 'tools', 'free', 'maps'])}" for _ in range(n * 8))


def test_segments_cover_the_text():
    texts = ["", "\n", "a", "日本語です。次です。", _prose(random.Random(1), 5), "x\n" * 50, "a b. c d! e", "", "don't go to x.example.com/a, v1.2 #tag _y_"]
    read = read_texts(texts)
    for i, text in enumerate(texts):
        own = read.text == i
        assert read.chars[own].sum() == len(text.lstrip(" "))
        alone = read_texts([text])
        assert (alone.codes == read.codes[own]).all() and (alone.segment == read.segment[own] - (read.segment[own][:1].sum() if own.any() else 0)).all()
    assert LANGUAGES[read_texts(["der Hund und die Katze sind nicht hier"]).language[0]] == "de"
    assert len(read_texts([]).codes) == 0


def _walk(text):
    """The segments and repetitions of one text, token by token."""
    import re

    from wharfside.llm import prose_model as pm

    known = pm._Known()
    segment, inside, line, far, ended, plain_before, recent, out = 0, 0, 0, 0, False, False, [], []
    for m in re.finditer(pm._SPACED, text):
        at = known[m[0]]
        code, role, content = int(known.code[at]), int(known.role[at]), int(known.content[at])
        if role == pm._FUNCTION_ROLE:
            far = 0
        if role == pm._CONTENT_ROLE:
            far += 1
            code += [0, 1, 2, 3, 4, 4, 4, 5, 5, 5, 6][min(far, 10)] * 4
            if content:
                seen = recent[-pm.RECENT :].count(content)
                code += 0 if not seen else 1 if seen == 1 else 2 if seen < 5 else 3
                recent.append(content)
        if ended and role not in (pm._MARK_ROLE, pm._END_ROLE):
            segment, inside, ended = segment + 1, 0, False
        out.append((code, segment))
        inside += 1
        line += 1
        if role in (pm._LINE_ROLE, pm._BREAK_ROLE):
            plain = line <= pm.LINE_TOKENS
            if not (plain and plain_before) or inside >= pm.BLOCK_TOKENS or role == pm._BREAK_ROLE:
                ended = True
            plain_before, line = plain, 0
        elif role == pm._END_ROLE:
            ended, plain_before = True, False
    return out


def test_arrays_read_as_a_walk_does():
    rng = random.Random(9)
    words = ["the", "a", "tool", "Tool", "TOOL", "map", "x1", "12", "https://a.example/b", "#tag", ".", "!", ",", "(", "\n", "\n\n", "日本", "です", "カタ", "。", "and", "key", "key"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(120)]
    read = read_texts(texts)
    for i, text in enumerate(texts):
        own = read.text == i
        segment = read.segment[own] - (read.segment[own][0] if own.any() else 0)
        assert list(zip(read.codes[own].tolist(), segment.tolist(), strict=True)) == _walk(text)


def test_model_is_the_counted_one():
    """Probabilities equal those of plain counting over distinct n-grams of pages."""
    import math
    from collections import Counter

    import numpy as np

    from wharfside.llm import prose_model as pm

    rng = random.Random(4)
    texts = [_prose(rng, 6) for _ in range(30)]
    read = read_texts(texts)
    model = pm.ProseModel(read, np.arange(len(read.codes)), read.text_starts())
    counts = [Counter(), Counter(), Counter()]
    for i in range(len(texts)):
        padded = [pm.START, pm.START, *read.codes[read.text == i].tolist()]
        for n in range(3):
            counts[n].update({tuple(padded[j - n : j + 1]) for j in range(2, len(padded))})
    totals = [Counter() for _ in counts]
    for total, c in zip(totals, counts, strict=True):
        for k, v in c.items():
            total[k[:-1]] += v
    a, b, c = read.codes[:3].tolist()
    p = (counts[0][c,] + 0.5) / (totals[0][()] + 500)
    p = (counts[0][c,] + 5 * pm.PRIOR * p) / (totals[0][()] + 5 * pm.PRIOR)
    if counts[0][b,] >= pm.LEAST_PAGES:
        p = (counts[1][b, c] + pm.PRIOR * p) / (totals[1][b,] + pm.PRIOR)
    if counts[1][a, b] >= pm.LEAST_PAGES:
        p = (counts[2][a, b, c] + pm.PRIOR * p) / (totals[2][a, b] + pm.PRIOR)
    assert abs(model.per_token(read, read.text_starts())[2] + math.log2(p)) < 1e-9


def test_ten_labels_are_fitted():
    rng = random.Random(2)
    fitted = spam_pages.fit([(_spam(rng, 4) if i % 3 == 0 else _prose(rng, 8), 1 if i % 3 == 0 else -1) for i in range(10)])
    held = read_texts([_prose(rng, 8), _spam(rng, 4)])
    bits, chars, _ = fitted.model.segments(held)
    assert [x > 0.5 for x in spam_pages.abnormal_share(held, 2, bits, chars, fitted.low, fitted.high)] == [False, True]
    assert spam_pages.fit([("Some text.", -1)]).model is not None and spam_pages.fit([("x x x", 1)]).model is None


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    pages = []
    for i in range(500):
        spam = rng.random() < 0.3
        share = rng.uniform(0.7, 1) if spam else rng.uniform(0, 0.3)
        total = rng.randint(6, 20)
        parts = [_spam(rng, 3)] if spam else [_prose(rng, total)]
        if not spam and rng.random() < 0.3:
            parts.append(_spam(rng, 1)[: int(len(parts[0]) * share)])
        elif spam and share < 0.9:
            parts.append(_prose(rng, 1))
            if len(parts[1]) > len(parts[0]) * 0.6:
                parts.pop()
        pages.append((i, "\n".join(parts), spam))
    labels = []
    for i, _, spam in pages[:250]:
        for r in range(rng.choice([1, 2])):
            right = rng.random() > 0.06
            labels.append((i, f"r{r}", ("spam" if spam else "page") if right else rng.choice(["unsure", "page" if spam else "spam"]), None))
    documents = spark.createDataFrame([(i, t, "s") for i, t, _ in pages] + [(900, None, "s"), (901, "", "s"), (902, " \n ", "s"), (903, "long words here. " * 50_000, "s")], "doc_id bigint, text string, abnormal_share string")
    votes = spark.createDataFrame([*labels, (None, "r", "spam", None), (1, None, None, None)], "doc_id bigint, rater string, verdict string, labeled_at timestamp")
    found = {r.doc_id for r in spam_pages.spam_pages(documents, votes).collect()}
    held_out = pages[250:]
    wrong = sum((i in found) != spam for i, _, spam in held_out)
    assert wrong <= 0.04 * len(held_out)
    assert not found & {900, 901, 902}
    scored = spam_pages.score_pages(documents, spam_pages.fit(spam_pages.labelled_pages(documents, votes)))
    assert scored.count() == 501


def test_all_labelled_pages_are_fitted(spark):
    """Of more than 3000 labelled pages each counts, and parts summed by Spark give the model and limits of one part."""
    import numpy as np

    rng = random.Random(5)
    pages = [(_spam(rng, 1), 1) if i % 5 == 0 else (_prose(rng, 2), -1) for i in range(3200)]
    documents = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pages)], "doc_id bigint, text string")
    votes = spark.createDataFrame([(i, "r", "spam" if v > 0 else "page", None) for i, (_, v) in enumerate(pages)], "doc_id bigint, rater string, verdict string, labeled_at timestamp")
    fitted, alone = spam_pages.fit(spam_pages.labelled_pages(documents, votes)), spam_pages.fit(pages)
    assert (fitted.low, fitted.high) == (alone.low, alone.high)
    for name in ("pages", "one", "two", "three", "three_pages"):
        assert np.array_equal(getattr(fitted.model, name), getattr(alone.model, name))


def test_no_labels(spark):
    documents = spark.createDataFrame([(1, "Some text.")], "doc_id bigint, text string")
    votes = spark.createDataFrame([], "doc_id bigint, rater string, verdict string, labeled_at timestamp")
    assert spam_pages.spam_pages(documents, votes).count() == 0
    assert spam_pages.spam_pages(documents.limit(0), votes).count() == 0


def test_repetition_is_abnormal():
    rng = random.Random(3)
    model = train_on_prose([_prose(rng, 8) for _ in range(60)], [_spam(rng, 4) for _ in range(20)])
    prose = model.segments(read_texts([_prose(rng, 6)]))[0].mean()
    assert model.segments(read_texts(["skill pack " * 60]))[0].mean() > prose + 2
