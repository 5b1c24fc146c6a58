"""A trigram model of function words and word classes, trained on prose (plain Python and numpy, used inside Arrow functions).

Texts are read in batches: the tokens of all texts of a batch are looked up
once for each distinct token, and everything after that (distance to the last
function word, repetitions, segments, probabilities) is arithmetic on arrays.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np

#: Function words of the languages of the corpus. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of to in on at for with from by and or but if when while because before after until unless than that which what who this these it its is are was be been has have had does do not never may can every each any all no only so we they you my our your one as about",
    "de": "der die das den dem des ein eine einen einer und oder aber wenn weil damit obwohl bevor nach mit von für auf im in zu zum nicht ist sind wird werden hat sie er es kann muss alle jeder jede auch noch einmal",
    "es": "el la los las un una de del y o pero si porque aunque para por con en sin no es son se su que antes después cada todos lo más",
    "fr": "le les un une des du et ou mais si parce car pour par avec dans sans ne pas est sont il elle se sa son que qui avant après chaque tous afin même au aux",
    "pt": "o os as um uma do da dos das e mas se porque embora para por com em sem não é são seu sua antes depois cada todos mais",
    "ja": "の は を に が と で も から まで です ます ました ません する した し して ない れる",
}
LANGUAGES = list(FUNCTION_WORDS)
_FUNCTION = {w for words in FUNCTION_WORDS.values() for w in words.split()}

_FORM = (
    r"(?P<url>(?:https?://|www\.)[^\s)\]|,;]+|\b[\w-]++(?:\.[\w-]+)+\.[a-z]{2,}[^\s)\]|,;]*)"
    r"|(?P<tag>#[^\W_][\w-]*)"
    r"|(?P<han>[㐀-鿿]+)|(?P<hira>[ぁ-ゟ]+)|(?P<kata>[゠-ヿ]+)"
    r"|(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)"
    r"|(?P<code>[^\W_]*\d[\w.,-]*\w|\d)"
    r"|(?P<line>\n+)"
    r"|(?P<mark>[^\w\s]|_)"
)
_TOKEN = re.compile(_FORM)
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A Latin word where nothing longer can start: the most frequent token, tried before the others.
_QUICK = rf"[{_LATIN}]++(?:['’-][{_LATIN}]++)*+(?=[\s,;)!?\"]|\.?(?:\s|\Z))"
#: A token with the space after it.
_SPACED = re.compile("(?:" + _QUICK + "|" + re.sub(r"\?P<\w+>", "?:", _FORM) + r")[^\S\n]*+")
#: How many content words back a repetition is noticed.
RECENT = 40
#: A run of lines without sentence end is joined up to so many tokens; lines up to LINE_TOKENS are short.
BLOCK_TOKENS, LINE_TOKENS = 40, 14
#: Content tokens since the last function word, as far as they are told apart.
_FAR = np.array([0, 1, 2, 3, 4, 4, 4, 5, 5, 5, 6])
#: Earlier occurrences among the recent content words, as far as they are told apart.
_AGAIN = np.array([0, 1, 2, 2, 2, 3])
_END = frozenset(".!?。！？")

#: What a token does in the scan.
_FUNCTION_ROLE, _CONTENT_ROLE, _MARK_ROLE, _END_ROLE, _LINE_ROLE, _BREAK_ROLE = range(6)
#: Classes whose tokens carry content, those that don't, and the marks that are told apart. Fixed values.
_CONTENT_CLASSES = ["X", "W", "w", "han", "kata", "U", "#", "N", "A"]
_PLAIN_CLASSES = ["other", "start", "line", "hira"]
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‘’“”„…–—·•→★✓©®™°§€£¥、。・「」『』【】（），：；！？～"
_VARIANTS = 28
_CODES = {name: i * _VARIANTS for i, name in enumerate(_CONTENT_CLASSES)}
_CODES |= {name: i for i, name in enumerate([*_PLAIN_CLASSES, *sorted("f:" + w for w in _FUNCTION), *("m:" + c for c in _MARKS)], len(_CONTENT_CLASSES) * _VARIANTS)}
#: Number of classes; codes of classes are below it.
CLASSES = max(_CODES.values()) + 1
START = _CODES["start"]

_HITS = np.zeros((CLASSES, len(LANGUAGES)))
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _HITS[_CODES["f:" + _w], _i] += 1
_HITS[_CODES["hira"], LANGUAGES.index("ja")] += 1

#: Distinct tokens remembered; the memory is emptied before a batch when it is full.
KNOWN_MOST = 200_000


class _Known(dict):
    """Number of each token met; its class, role and content are in arrays under that number."""

    def __init__(self) -> None:
        super().__init__()
        self.code, self.role, self.content = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.size = 0
        self.plain: dict[tuple[int, int], int] = {}

    def __missing__(self, spaced: str) -> int:
        code, role, content = _kind_of(spaced)
        if not content and (code, role) in self.plain:
            at = self.plain[code, role]
        else:
            at = self.size
            if at == len(self.code):
                self.code, self.role, self.content = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code, self.role, self.content))
            self.code[at], self.role[at], self.content[at] = code, role, content
            self.size += 1
            if not content:
                self.plain[code, role] = at
        if len(spaced) <= 40:
            self[spaced] = at
        return at


def _kind_of(spaced: str) -> tuple[int, int, int]:
    """(class, role, key of the content whose repetition counts or 0) of a token."""
    m = _TOKEN.match(spaced)
    assert m
    word, group = m[0], m.lastgroup
    if group == "word":
        low = word.lower()
        loud = word.isupper() and len(word) > 1
        if low in _FUNCTION and not loud:
            return _CODES["f:" + low], _FUNCTION_ROLE, 0
        return _CODES["X" if loud else "W" if word[0].isupper() else "w"], _CONTENT_ROLE, hash(low) or 1
    if group == "hira":
        return _CODES["f:" + word if word in _FUNCTION else "hira"], _FUNCTION_ROLE, 0
    if group in ("han", "kata"):
        return _CODES[group], _CONTENT_ROLE, hash(word) or 1
    if group == "url":
        return _CODES["U"], _CONTENT_ROLE, 0
    if group == "tag":
        return _CODES["#"], _CONTENT_ROLE, hash(word.lower()) or 1
    if group == "code":
        return _CODES["N" if word.replace(",", "").replace(".", "").isdigit() else "A"], _CONTENT_ROLE, 0
    if group == "line":
        return _CODES["line"], _LINE_ROLE if len(word) == 1 else _BREAK_ROLE, 0
    return _CODES.get("m:" + word, _CODES["other"]), _END_ROLE if word in _END else _MARK_ROLE, 0


_known = _Known()


@dataclass
class Read:
    """The tokens of a batch of texts, in order."""

    #: Of each token: class, characters it stands for (with the space after it), number of its segment and of its text.
    codes: np.ndarray
    chars: np.ndarray
    segment: np.ndarray
    text: np.ndarray
    #: Of each segment its text; of each text its language.
    segment_text: np.ndarray
    language: np.ndarray

    def contexts(self, starts: np.ndarray) -> np.ndarray:
        """Key of (language, class two before, class before, class) of each token; at ``starts`` a sequence begins."""
        before = np.roll(self.codes, 1)
        before[starts] = START
        two = np.roll(before, 1)
        two[starts] = START
        return ((self.language[self.text] * CLASSES + two) * CLASSES + before) * CLASSES + self.codes

    def text_starts(self) -> np.ndarray:
        return np.diff(self.text, prepend=-1) != 0

    def segment_starts(self) -> np.ndarray:
        return np.diff(self.segment, prepend=-1) != 0


def read_texts(texts: list[str]) -> Read:
    """Read a batch of texts, whole. A segment is a sentence, or a line or run of short lines without sentence end."""
    global _known
    if _known.size > KNOWN_MOST or len(_known) > KNOWN_MOST:
        _known = _Known()
    tokens: list[str] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = _SPACED.findall(text)
        lengths[i] = len(own)
        tokens += own
    n = len(tokens)
    at = np.fromiter(map(_known.__getitem__, tokens), dtype=np.int64, count=n)
    chars = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
    codes, role, content = _known.code[at], _known.role[at], _known.content[at]
    text = np.repeat(np.arange(len(texts)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])
    hits = _HITS[codes[role == _FUNCTION_ROLE]]
    of = text[role == _FUNCTION_ROLE]
    votes = np.stack([np.bincount(of, weights=hits[:, i], minlength=len(texts)) for i in range(len(LANGUAGES))], axis=1) if len(texts) else np.zeros((0, len(LANGUAGES)))
    if n:
        carries = role == _CONTENT_ROLE
        codes = codes + np.where(carries, _FAR[np.minimum(_since_function(role, carries, first), 10)] * 4, 0)
        codes[content != 0] += _AGAIN[np.minimum(_seen_before(content, text), 5)]
    segment = np.cumsum(_segment_starts(role, first)) - 1 if n else np.zeros(0, dtype=np.int64)
    begins = np.diff(segment, prepend=-1) != 0
    return Read(codes, chars, segment, text, text[begins], votes.argmax(axis=1))


def _since_function(role: np.ndarray, carries: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Content tokens since the last function word of the text, this one included."""
    count = np.cumsum(carries)
    reset = np.where(role == _FUNCTION_ROLE, count, 0)
    begins = first[:-1][np.diff(first) > 0]
    reset[begins] = np.maximum(reset[begins], count[begins] - carries[begins])
    return count - np.maximum.accumulate(reset)


def _seen_before(content: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each token with content, how often its text has it among the RECENT content words before."""
    has = np.flatnonzero(content)
    key = content[has].astype(np.uint64) + text[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    place = group * (len(has) + 2 * RECENT) + order  # the word's place among all, apart for each key
    seen = np.empty(len(has), dtype=np.int64)
    seen[order] = np.arange(len(has)) - np.searchsorted(place, place - RECENT)
    return seen


def _segment_starts(role: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a segment starts at each token; only line and sentence ends are walked through."""
    n = len(role)
    out = np.zeros(n, dtype=np.int64)
    opens = np.flatnonzero((role != _MARK_ROLE) & (role != _END_ROLE))
    events = np.flatnonzero(role >= _END_ROLE)
    after = np.append(opens, n)[np.searchsorted(opens, events + 1)].tolist()  # where the next segment would start
    kinds, places = role[events].tolist(), events.tolist()
    limits = np.searchsorted(events, first).tolist()
    starts = first.tolist()
    for t in range(len(starts) - 1):
        begin, stop = starts[t], starts[t + 1]
        if begin == stop:
            continue
        out[begin] = 1
        last_line, ended, plain_before = begin - 1, -1, False
        for k in range(limits[t], limits[t + 1]):
            e = places[k]
            if 0 <= ended <= e:
                out[ended] = 1
                begin, ended = ended, -1
            if kinds[k] == _END_ROLE:
                plain_before = False
                if ended < 0:
                    ended = after[k]
            else:
                plain = e - last_line <= LINE_TOKENS
                if ended < 0 and (not (plain and plain_before) or e - begin + 1 >= BLOCK_TOKENS or kinds[k] == _BREAK_ROLE):
                    ended = after[k]
                plain_before, last_line = plain, e
        if 0 <= ended < stop:
            out[ended] = 1
    return out


#: A context is used only when it is in this share of its language's training pages, and at least in LEAST_PAGES.
RARE_SHARE, LEAST_PAGES = 0.02, 2.0
#: Weight of the shorter context, in pages.
PRIOR = 3.0
#: Numbers of n-grams: keys of ``Read.contexts`` come first, then from here pairs, single classes and pages, each with its language; and the end.
PAIRS = len(LANGUAGES) * CLASSES**3
SINGLES = PAIRS + len(LANGUAGES) * CLASSES**2
PAGES = SINGLES + len(LANGUAGES) * CLASSES
GRAMS = PAGES + len(LANGUAGES)


def count_grams(read: Read, taken: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of the tokens ``taken``, ascending, and the pages each is in; sequences begin at ``starts``."""
    of, keys = np.divmod(np.unique(read.text[taken] * GRAMS + read.contexts(starts)[taken]), GRAMS)
    lang = keys // CLASSES**3
    shorter = (PAIRS + lang * CLASSES**2 + keys % CLASSES**2, SINGLES + lang * CLASSES + keys % CLASSES, PAGES + lang)
    return np.unique(np.concatenate([keys, *(np.unique(of * GRAMS + g) % GRAMS for g in shorter)]), return_counts=True)


def used_contexts(grams: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Pairs that are a context in any of the models whose counts are the columns of ``pages``; all other keys of three are never looked up.

    A page has only so many distinct pairs and a context is in RARE_SHARE of
    the pages, so their number doesn't grow with the pages.
    """
    whole = np.zeros((len(LANGUAGES), pages.shape[1]))
    whole[grams[grams >= PAGES] - PAGES] = pages[grams >= PAGES]
    pair = (grams >= PAIRS) & (grams < SINGLES)
    number = grams[pair] - PAIRS
    return number[(pages[pair] >= np.maximum(LEAST_PAGES, RARE_SHARE * whole)[number // CLASSES**2]).any(axis=1)]


class ProseModel:
    """Interpolated trigram model over token classes, one per language.

    An n-gram counts once a page, so that one wrongly labelled page of endless
    repetitions cannot make repetitions likely.
    """

    def __init__(self, read: Read, taken: np.ndarray, starts: np.ndarray):
        """Trained on the tokens ``taken`` of ``read``, in sequences that begin at ``starts``."""
        self._count(*count_grams(read, taken, starts))

    @classmethod
    def counted(cls, grams: np.ndarray, pages: np.ndarray) -> ProseModel:
        """From n-grams, ascending, and the pages each is in."""
        model = cls.__new__(cls)
        model._count(grams[pages > 0], pages[pages > 0])
        return model

    def _count(self, grams: np.ndarray, pages: np.ndarray) -> None:
        ends = np.searchsorted(grams, [PAIRS, SINGLES, PAGES])
        three, two, one, whole = zip(np.split(grams, ends), np.split(pages, ends), strict=True)
        self.three, self.three_pages = three
        self.two = np.zeros(len(LANGUAGES) * CLASSES**2, dtype=np.int32)
        self.two[two[0] - PAIRS] = two[1]
        self.one = np.zeros((len(LANGUAGES), CLASSES), dtype=np.int64)
        self.one.flat[one[0] - SINGLES] = one[1]
        self.pages = np.zeros(len(LANGUAGES), dtype=np.int64)
        self.pages[whole[0] - PAGES] = whole[1]
        self._add_totals()

    def _add_totals(self) -> None:
        self.all_one = self.one.sum(axis=1)
        self.all_two = self.two.reshape(-1, CLASSES).sum(axis=1)
        self.contexts, at = np.unique(self.three // CLASSES, return_inverse=True)
        self.all_three = np.bincount(at, weights=self.three_pages, minlength=1)
        self.pooled = self.one.sum(axis=0)

    def __getstate__(self) -> dict[str, Any]:
        at = np.flatnonzero(self.two)
        return {"pages": self.pages, "one": self.one, "two": (at, self.two[at]), "three": self.three, "three_pages": self.three_pages}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__ |= state
        self.two = np.zeros(len(LANGUAGES) * CLASSES**2, dtype=np.int32)
        self.two[state["two"][0]] = state["two"][1]
        self._add_totals()

    def surprise(self, keys: np.ndarray) -> np.ndarray:
        """Negative log2 probability of the last class of each key of ``Read.contexts`` after the two before it."""
        pair, last = keys // CLASSES, keys % CLASSES
        lang, before = pair // CLASSES**2, pair % CLASSES
        p = (self.pooled[last] + 0.5) / (self.pooled.sum() + 500)
        p = (self.one[lang, last] + 5 * PRIOR * p) / (self.all_one[lang] + 5 * PRIOR)
        least = np.maximum(LEAST_PAGES, RARE_SHARE * self.pages)[lang]
        short = lang * CLASSES + before
        p = np.where(self.one[lang, before] >= least, (self.two[short * CLASSES + last] + PRIOR * p) / (self.all_two[short] + PRIOR), p)
        if not len(self.three):
            return -np.log2(p)
        at = np.minimum(np.searchsorted(self.three, keys), len(self.three) - 1)
        of = np.minimum(np.searchsorted(self.contexts, pair), len(self.contexts) - 1)
        long = np.where(self.three[at] == keys, self.three_pages[at], 0)
        all_three = np.where(self.contexts[of] == pair, self.all_three[of], 0)
        return -np.log2(np.where(self.two[pair] >= least, (long + PRIOR * p) / (all_three + PRIOR), p))

    def per_token(self, read: Read, starts: np.ndarray) -> np.ndarray:
        keys, at = np.unique(read.contexts(starts), return_inverse=True)
        return self.surprise(keys)[at]

    def segments(self, read: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per segment of a batch: mean surprise of its tokens, characters, tokens."""
        size = np.bincount(read.segment)
        return np.bincount(read.segment, weights=self.per_token(read, read.text_starts())) / size, np.bincount(read.segment, weights=read.chars), size


@dataclass
class Training:
    """A model to be trained on the pages outside a fold (-1: on all), in so many rounds."""

    without: int
    rounds: int


class Labelled:
    """Labelled pages read together, of which some are prose and some spam, some labels being wrong and some spam pages holding prose.

    ``votes``: for spam minus for prose. Of as many pages as there are, each
    belongs to one such part; what parts give is summed.
    """

    def __init__(self, read: Read, votes: np.ndarray, fold: np.ndarray):
        self.read, self.votes, self.fold = read, votes, fold
        self.prose = votes < 0
        # A segment by itself: its contexts are the same in every round.
        self.order = read.segment_starts()
        self.keys, self.at = np.unique(read.contexts(self.order), return_inverse=True)
        self.sizes = np.bincount(read.segment)

    def packed(self) -> bytes:
        read = self.read
        small = [(read.codes, np.int16), (read.chars, np.int32), (read.segment, np.int32), (read.text, np.int32), (read.segment_text, np.int32), (read.language, np.int8)]
        return pickle.dumps(([x.astype(kind) for x, kind in small], self.votes, self.fold))

    @classmethod
    def unpacked(cls, packed: bytes) -> Labelled:
        small, votes, fold = pickle.loads(packed)  # noqa: S301: written by this library a moment ago
        return cls(Read(*(x.astype(np.int64) for x in small)), votes, fold)

    def _grams(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ``chosen`` segments; neighbours that are both chosen are one sequence."""
        read = self.read
        alone = np.ones(len(chosen), dtype=bool)
        alone[1:] = ~(chosen[:-1] & chosen[1:]) | (read.segment_text[1:] != read.segment_text[:-1])
        return count_grams(read, np.flatnonzero(chosen[read.segment]), self.order & alone[read.segment])

    def _mean(self, model: ProseModel) -> np.ndarray:
        return np.bincount(self.read.segment, weights=model.surprise(self.keys)[self.at]) / self.sizes

    def inside(self, training: Training) -> np.ndarray:
        return (self.fold != training.without)[self.read.segment_text]

    def prose_segments(self, before: tuple[ProseModel, ProseModel] | None) -> np.ndarray:
        """Segments less surprising under the prose model than under the spam model; at first those of pages labelled as prose."""
        return self.prose[self.read.segment_text] if before is None else self._mean(before[0]) <= self._mean(before[1])

    def bits(self, models: list[ProseModel]) -> tuple[np.ndarray, np.ndarray]:
        """Per segment: mean surprise under the model of its page's fold, characters."""
        read = self.read
        keys, at = np.unique(read.contexts(read.text_starts()), return_inverse=True)
        bits = np.zeros(len(read.segment_text))
        for k, model in enumerate(models):
            own = self.fold[read.segment_text] == k
            if own.any():
                bits[own] = (np.bincount(read.segment, weights=model.surprise(keys)[at]) / self.sizes)[own]
        return bits, np.bincount(read.segment, weights=read.chars)


@dataclass
class Round:
    """A round of trainings: the n-gram counts of what each takes for prose and for spam, in two columns each.

    ``before`` has the sums of the last round, with the columns of its own
    trainings; nothing in the first.
    """

    trainings: list[Training]
    number: int
    before: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict[str, Any]:
        return {k: self.__dict__[k] for k in ("trainings", "number", "before")}

    @cached_property
    def models(self) -> list[tuple[ProseModel, ProseModel] | None]:
        if self.before is None:
            return [None] * len(self.trainings)
        grams, pages = self.before
        return [(ProseModel.counted(grams, pages[:, 2 * i]), ProseModel.counted(grams, pages[:, 2 * i + 1])) for i in range(len(self.trainings))]

    @property
    def width(self) -> int:
        return 2 * len(self.trainings)

    def __call__(self, part: Labelled) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for training, before in zip(self.trainings, self.models, strict=True):
            inside, good = part.inside(training), part.prose_segments(before)
            # The spam model is needed for another round only.
            found += [part._grams(inside & good), part._grams(inside & ~good & (self.number < training.rounds))]
        grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        pages = np.zeros((len(grams), self.width), dtype=np.int64)
        pages[at, np.repeat(np.arange(self.width), [len(g) for g, _ in found])] = np.concatenate([n for _, n in found])
        return grams, pages


Sums = tuple[np.ndarray, np.ndarray]


def train(trainings: list[Training], total: Callable[[Round], Sums]) -> list[ProseModel]:
    """The prose model of each training. ``total`` sums what a round gives for all parts; keys of three without a used context may be left out.

    Segments start with their page's label; in each round both classes get a
    model and every segment moves to the one under which it is less
    surprising. Only the prose model is kept.
    """
    out: dict[int, ProseModel] = {}
    open_, before, number = list(range(len(trainings))), None, 0
    while open_:
        grams, pages = total(Round([trainings[i] for i in open_], number, before))
        for at, i in enumerate(open_):
            if trainings[i].rounds == number:
                out[i] = ProseModel.counted(grams, pages[:, 2 * at])
        stay = [at for at, i in enumerate(open_) if trainings[i].rounds > number]
        before = (grams, pages[:, [2 * at + c for at in stay for c in (0, 1)]])
        open_, number = [open_[at] for at in stay], number + 1
    return [out[i] for i in range(len(trainings))]


def train_on_prose(pages: list[str], spam: list[str], rounds: int = 4) -> ProseModel:
    """A prose model from labelled texts; see ``train``."""
    n = len(pages) + len(spam)
    part = Labelled(read_texts([*pages, *spam]), np.repeat([-1, 1], [len(pages), len(spam)]), np.zeros(n, dtype=np.int64))
    return train([Training(-1, rounds if pages and spam else 0)], lambda step: step(part))[0]


def abnormal_share(read: Read, texts: int, bits: np.ndarray, chars: np.ndarray, low: float, high: float) -> np.ndarray:
    """Share of each text's characters in segments whose surprise is below ``low`` or above ``high``; 0 for a text without tokens."""
    odd = (bits < low) | (bits > high)
    whole = np.bincount(read.segment_text, weights=chars, minlength=texts)
    return np.bincount(read.segment_text, weights=chars * odd, minlength=texts) / np.maximum(whole, 1)
