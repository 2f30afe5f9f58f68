"""Problem 4: defective prompt-answer pairs, by labelling functions and an expectation-maximization label model.

For each defect several noisy functions look at a pair, each by itself: it votes for the defect (1), against it (-1) or, where it can't tell, not at all (0). No function
decides for another. How often each vote pattern occurs among all pairs is counted in Spark; from these counts a label model per defect (votes independent given
the truth) learns by EM how far each function is to be trusted. A pair keeps every defect whose posterior passes a cutoff, which is chosen on pairs spoilt on purpose.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release, spread
from .sampling import seeded_sample

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")

#: Answers that only hold the place of one.
PLACEHOLDERS = frozenset("na n/a none null nil nan undefined empty blank tbd todo placeholder missing unavailable answer no_answer no_response no_reply no_output no_content not_available not_applicable insert_answer_here your_answer_here see_above".split())
#: What declines an answer, in six languages.
REFUSALS = re.compile(
    r"(?:can ?not|can['’]t|unable to|won['’]t|will not|not able to) (?:be able to )?(?:help|assist|provide|discuss|answer|share|comply|fulfil|do that|talk about|give)"
    r"|(?:must|have to|need to|going to) (?:decline|refuse|pass on)|i (?:decline|refuse) to|(?:not|n['’]t) feel comfortable|(?:not|n['’]t) comfortable|rather not|against my (?:guidelines|rules|policy|policies|programming)"
    r"|my (?:rules|guidelines|policies|instructions) (?:keep|prevent|forbid|do not|don['’]t)|outside what i am (?:permitted|allowed)|not (?:allowed|permitted) to|no answer can be given|beyond what i (?:can|may)"
    r"|no puedo (?:ayudar|responder|contestar|proporcionar|hablar|dar)|prefiero no|debo (?:negarme|rechazar|declinar)|no me es posible|no estoy (?:autorizad|en condiciones)|no se me permite"
    r"|ne (?:peux|puis) pas|(?:dois|préfère) (?:refuser|décliner|ne pas)|pas en mesure|pas autorisé|m['’]est impossible|impossible de répondre"
    r"|kann (?:ich )?(?:\w+ )*(?:nicht|keine)|darf ich (?:\w+ )*(?:nicht|keine)|muss ich (?:\w+ )*(?:ablehnen|passen)|möchte ich (?:\w+ )*nicht|nicht beantworten|lehne (?:ich )?ab|nicht weiterhelfen|nicht helfen"
    r"|não (?:posso|consigo|me é possível|estou autorizad|tenho permissão)|prefiro não|devo recusar|tenho que recusar|recuso-me"
    r"|не (?:могу|вправе|буду|в состоянии|имею права|смогу)|вынужден[аы]? отказать|отказываюсь|мне нельзя|не разрешено|предпочту не",
    re.I,
)
#: Words by which a speaker means themselves, and beginnings of words that deny or decline, in eight languages.
PERSON = frozenset("i me my mine myself i'm i'd i'll we us our assistant model yo me mi mí nosotros je j me moi mon ma ich mir mich mein meine wir eu mim meu minha я мне меня мной мой моя io mi mio ik mij mijn quiero puedo debo prefiero estoy posso devo quero prefiro voglio могу хочу".split())
UNWILLING = tuple(
    "cannot instruct unable unanswered unwilling declin refus avoid reject forbid forbidden prohibit prevent restrict permit allowed allow comfortable rather prefer pass skip limits off outside beyond against guideline policy policies rules won can't won't don't "
    "puedo posible prefiero rechaz negar autoriz permit condicion refus déclin impossible préfère peux puis mesure autoris nicht kein ablehn lehne verweiger darf não posso recus prefiro permiss impossível могу нельзя отказ вправе предпоч запрещ non rifiut posso niet weiger helaas".split()
)
NEGATION = frozenset("not no never nothing none cannot t nicht kein keine keinen nie ne pas jamais no nunca não nunca не ни нет нельзя non mai niet geen nooit".split())
#: What goes with a refusal and says nothing either.
COURTESY = re.compile(
    r"^\W*(?:(?:i['’]?m|i am) (?:very |so )?sorry|sorry|unfortunately|hmm|i apologize|my apologies|thank you|thanks|please (?:ask|consult|try|contact|rephrase)|perhaps (?:a different|another)|is there (?:another|anything|something)|"
    r"lo siento|gracias|por favor|quizás|tal vez|désolé|je suis désolé|merci|veuillez|peut-être|es tut mir leid|leider|danke|bitte|vielleicht|desculpe|lamento|obrigad|talvez|извините|простите|к сожалению|спасибо|пожалуйста|возможно|может быть)",
    re.I,
)
#: A refusing phrase that goes on with an answer.
GOES_ON = re.compile(r"(?:can ?not|can['’]t|not able to|unable to)[^.!?]*,? (?:but|yet|and here|though|however)\b", re.I)
#: Requests to give the text back, and requests that name a language.
ASKS_COPY = re.compile(r"\b(?:repeat|echo|return the (?:text|sentence)|word for word|verbatim|copy (?:this|the)|correct the (?:spelling|grammar)|proofread|quote|wiederhol|répète|répéter|repite|repita|повтори|wörtlich|mot pour mot|palabra por palabra|palavra por palavra|слово в слово)", re.I)
ASKS_LANGUAGE = re.compile(
    r"\b(?:translat|in (?:english|german|french|spanish|portuguese|russian)|into (?:english|german|french|spanish|portuguese|russian)|(?:english|german|french|spanish|portuguese|russian) (?:text|version|sentence|word)|"
    r"übersetz|auf (?:englisch|deutsch|französisch|spanisch|portugiesisch|russisch)|tradui|en (?:anglais|français|allemand|espagnol|portugais|russe)\b|traduc|traduz|traduç|en (?:inglés|español|alemán|francés|portugués|ruso)\b|"
    r"em (?:inglês|português|alemão|francês|espanhol|russo)\b|перевед|перевод|на (?:английск|русск|немецк|французск|испанск|португальск))",
    re.I,
)
#: Words that mark one language.
MARKERS = {
    "en": "the and is of to that it with for was are this which how what why would between from when has have an in its you can does please me about",
    "de": "der die das und ist nicht ein eine auch den dem des mit auf für von wie wenn sich wird ich man vor aus über etwa ohne bei",
    "fr": "le la les des et est une du que dans pour avec sur au mais il ce qui sait ans ne pas je vous à aux sans très",
    "es": "el la los las y es una del que con por pero según para se desde al muy como sin también si más",
    "pt": "o os as e é uma do da que com não para em mas até ao pois dos das na no se mais então sem",
    "ru": "и в не на что с по из у после за его а но как это все для же через без",
}
_MARKS = {w: [k for k, v in MARKERS.items() if w in v.split()] for words in MARKERS.values() for w in words.split()}
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+")
#: Words that no sentence ends with.
DANGLING = frozenset("the a an of in on at to for with by from and or but that which because if when as than such its their his her this these into between der die das und oder mit von für ein eine le la les des et ou mais que avec pour un une el los las y o pero con por para de da do os as e и в на с но что".split())
#: Letters beyond ASCII that belong to one of the languages.
LETTERS = {"de": "äöüß", "fr": "èêëàâùûçœîï", "es": "ñ¿¡", "pt": "ãõ"}

_MARKING = {w: [(list(MARKERS).index(k), 6 // len(v)) for k in v] for w, v in _MARKS.items()}  # a word that marks up to three languages votes for each in sixths
_CYRILLIC = re.compile("[Ѐ-ӿ]+")
_LISTED = re.compile(r"(?:^|\n)[ \t]*(?:[-*•]|\d{1,3}[.)])(?=\s|$)")
_STOPS = (".", "!", "?")
_SUM = re.compile(r"\d+ [-+*/] \d+ = ")
_REMEMBERED = 200_000  # words whose properties a task keeps


_TONGUES = list(MARKERS)
_BETWEEN = "\x01"  # stands between texts that are split together
#: Of each character of the basic plane: itself, or a blank if no word has it.
_SPELT = np.array([c if chr(c).isalnum() or chr(c) == _BETWEEN else 32 for c in range(1 << 16)], "<u4")
_UNSPELT = re.compile(r"[^\w\x01]|_")


class _Numbers(dict):
    """A number for each word met; the words of MARKERS have the first ones, behind that of _BETWEEN."""

    def __init__(self):
        self.words = [_BETWEEN, *_MARKING]  # by number
        super().__init__(zip(self.words, range(len(self.words))))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.words.append(word)
        return n


_MARKED = np.zeros((len(_MARKING) + 1, len(MARKERS)))
for _k, _votes in enumerate(_MARKING.values(), 1):
    for _tongue, _sixths in _votes:
        _MARKED[_k, _tongue] = _sixths


def parts(items: list, size, most: int = 1000, characters: int = 2_000_000) -> Iterator[list]:
    """Items one after the other, in lists of bounded length and of bounded sum of size(item), if no item alone is larger."""
    some, sum_ = [], 0
    for x in items:
        if some and (len(some) == most or sum_ + size(x) > characters):
            yield some
            some, sum_ = [], 0
        some.append(x)
        sum_ += size(x)
    if some:
        yield some


def pair_size(pair: tuple[str | None, str | None]) -> int:
    return len(pair[0] or "") + len(pair[1] or "")


def split_together(texts: list[str]) -> list[str]:
    """The words of lower-case texts as WORD finds them, with _BETWEEN between two texts. All else becomes blanks, which is faster than the pattern."""
    together = f" {_BETWEEN} ".join(texts)
    if together.count(_BETWEEN) >= len(texts):
        together = f" {_BETWEEN} ".join(t.replace(_BETWEEN, " ") for t in texts)
    codes = np.frombuffer(together.encode("utf-32-le", "surrogatepass"), "<u4")
    if codes.max(initial=0) >= len(_SPELT):
        return _UNSPELT.sub(" ", together).split()
    return _SPELT.take(codes).tobytes().decode("utf-32-le").split()


def numbered(words: list[str], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words that split_together() gives, and how many each text has."""
    all_ = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    between = np.flatnonzero(all_ == 0)
    return all_[all_ > 0], np.diff(np.append(between - np.arange(len(between)), len(all_) - len(between)), prepend=0)


def _speaking(words: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """By text the sixths of votes that marking words give to each language. words, of: numbers of words, and of their texts."""
    at = np.flatnonzero(words < len(_MARKED))
    words, of = words[at], of[at]
    return np.stack([np.bincount(of, _MARKED[words, k], n) for k in range(len(MARKERS))], 1)


def _own(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, of: those that each text has, once; and how often it has them."""
    both = np.sort(of << 32 | words)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    both, times = both[first], np.diff(first, append=len(both))
    return both & 0xFFFFFFFF, both >> 32, times


def _tongues(sixths: np.ndarray, least: int) -> np.ndarray:
    """By text the place in MARKERS of the language that most marking words speak for; -1 if too few do or two are level."""
    second, first = np.sort(sixths, 1)[:, -2:].T
    return np.where((first >= 6 * least) & (10 * second <= 7 * first), sixths.argmax(1), -1)


def languages(texts: list[str], least: int = 2) -> list[str | None]:
    """The language of each text in lower case, see _tongues()."""
    out = []
    for some in parts(texts, len):
        words, sizes = numbered(split_together(some), _Numbers())
        out += _tongues(_speaking(words, np.repeat(np.arange(len(some)), sizes), len(some)), least).tolist()
    return [_TONGUES[k] if k >= 0 else None for k in out]


def language(words: list[str], least: int = 2) -> str | None:
    """The language that most marking words speak for; None if too few do or two are level."""
    sixths = [0] * len(MARKERS)
    for w, n in Counter(filter(_MARKING.__contains__, words)).items():
        for k, part in _MARKING[w]:
            sixths[k] += n * part
    second, first = sorted(sixths)[-2:]
    return _TONGUES[sixths.index(first)] if first >= 6 * least and 10 * second <= 7 * first else None


DENIAL, SELF, ASKING_COPY, ASKING_LANGUAGE, FIGURE = _BITS = 1, 2, 4, 8, 16
#: Beginnings of words of which every request for a copy, or for a language, has one; a quick look before the patterns.
COPY_CUES = tuple("repeat echo return word verbatim copy correct proofread quote wiederhol répèt répét repite repita повтори wörtlich mot palabra palavra слово".split())
LANGUAGE_CUES = tuple(
    "translat english german french spanish portuguese russian übersetz englisch deutsch französisch spanisch portugiesisch russisch tradu anglais français allemand espagnol portugais russe inglés español alemán francés portugués ruso inglês português alemão francês espanhol russo "
    "перевед перевод английск русск немецк французск испанск португальск".split()
)


def _flags(word: str) -> int:
    return (DENIAL * (word in NEGATION or word.startswith(UNWILLING))) | (SELF * (word in PERSON)) | (ASKING_COPY * word.startswith(COPY_CUES)) | (ASKING_LANGUAGE * word.startswith(LANGUAGE_CUES)) | (FIGURE * word.isdigit())


@lru_cache(_REMEMBERED)
def _denies(word: str) -> bool:
    return _flags(word) & DENIAL > 0


def _trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _fragment_features(words: list[str], commas: int) -> list[str]:
    head, last = " ".join(words[:2]), words[-1]
    return [f"n {head} {min(len(words), 14)}", f"l {last}", f"b {' '.join(words[-2:])}", f"f {words[0]} {last}", f"h {head} {last}", f"c {head} {commas} {min(len(words), 14)}", f"s {len(words)}"]


def _log_odds(counts: dict[str, tuple[int, int]], totals: tuple[int, int], add: float = 0.3) -> dict[str, float]:
    bad, good = (math.log(n + 1) for n in totals)
    return {f: math.log(b + add) - bad - math.log(g + add) + good for f, (b, g) in counts.items()}


def _hash(text: str) -> int:
    return crc32(text.encode("utf-8", "replace"))


def _place(hashed, n):
    """A place from 2 to n - 1, by a text's hash: the same in whatever order texts come."""
    return 2 + hashed % (n - 2)


class Tally:
    """Counts of what a Lore is made from, over messages in any order. Each has a kind, a key, and how often it is met in what is broken off or declines (bad) and in the rest (good).

    Words are numbers here. Of each sentence a few of them are kept, of which table() makes the keys of _fragment_features().
    """

    def __init__(self):
        self.numbers = _Numbers()
        self.counts = np.zeros((len(MARKERS) + 3, 0), np.int64)  # by number of a word: how often it is met; in how many texts of each language; in how many answers that decline, and that don't
        self.denial = np.zeros(0, bool)  # by number
        self.sentences: list[np.ndarray] = []  # first two words, last two words, words, commas, whether it is whole
        self.n = Counter()

    def add(self, pairs: list[tuple[str, str]]) -> None:
        for some in parts(pairs, pair_size):
            self._add(some)

    def _grow(self) -> None:
        new = self.numbers.words[len(self.denial) :]
        if new:
            self.denial = np.append(self.denial, [_flags(w) & DENIAL > 0 for w in new])
            self.counts = np.pad(self.counts, ((0, 0), (0, len(new))))

    def _add(self, pairs: list[tuple[str, str]]) -> None:
        texts = [text for p in pairs for text in p]
        each = [SENTENCE_END.split(t.lower()) for t in texts]
        flat = [s for some in each for s in some]
        words, sizes = numbered(split_together(flat), self.numbers)
        self._grow()
        met, spoken, declined = self.counts[0], self.counts[1:-2], self.counts[-2:]
        met += np.bincount(words, minlength=len(met))
        past = np.cumsum(sizes)
        of_text = np.add.reduceat(sizes, np.cumsum([0, *map(len, each[:-1])]))
        # The last word may be the beginning of one where the text ends on it; in a large corpus such beginnings repeat.
        last = np.array([t[-1:].isalnum() for t in texts]) & (of_text > 0)
        met -= np.bincount(words[np.cumsum(of_text)[last] - 1], minlength=len(met))

        of = np.repeat(np.arange(len(texts)), of_text)
        tongue = _tongues(_speaking(words, of, len(texts)), 4)
        own, of, _ = _own(words, of)
        for k in range(len(MARKERS)):
            spoken[k] += np.bincount(own[tongue[of] == k], minlength=len(met))
        denies = np.bincount(of, self.denial[own], len(texts)) > 0  # every wording of REFUSALS has such a word: a quick look before the pattern
        for k in np.flatnonzero(denies[1::2] & (of_text[1::2] < 60)).tolist():
            denies[2 * k + 1] = REFUSALS.search(texts[2 * k + 1]) is not None and GOES_ON.search(texts[2 * k + 1]) is None
        denies &= of_text < 60
        answered = of % 2 == 1
        for k, those in enumerate((denies[of], ~denies[of])):
            declined[k] += np.bincount(own[answered & those], minlength=len(met))

        whole = [k for k in np.flatnonzero(sizes >= 4).tolist() if flat[k].rstrip("\"”’»)").endswith(_STOPS)]
        n, at = sizes[whole], (past - sizes)[whole]
        commas = np.array([flat[k].count(",") for k in whole], np.int64)
        kept = _place(np.array([_hash(flat[k]) for k in whole], np.int64), n)
        for size, c, is_whole in ((n, commas, 1), (kept, np.minimum(commas, 1), 0)) if whole else ():
            self.sentences.append(np.stack([words[at], words[at + 1], words[at + size - 2], words[at + size - 1], size, c, np.full(len(n), is_whole)]).astype(np.int32))
        self.n["pair"] += len(pairs)
        self.n["sentence"] += len(whole)

    def full(self) -> bool:
        """Whether it is time to hand on what is counted: up to some 100 MB are held until then."""
        return len(self.numbers) > 200_000 or self.n["sentence"] > 400_000

    def tables(self) -> Iterator[pa.Table]:
        """kind, key, bad, good, in some pieces."""

        def table(kind, keys, bad, good):
            return pa.table({"kind": pa.repeat(kind, len(keys)), "key": keys, "bad": pa.array(bad, pa.int64()), "good": pa.array(good, pa.int64())})

        if not self.n:
            return
        words = pa.array(self.numbers.words, pa.string())
        met, *spoken, bad, good = self.counts
        for kind, bad, good in (("word", 0 * met, met), *((f"spoken {k}", 0 * met, c) for k, c in zip(MARKERS, spoken)), ("declined", bad, good)):
            some = np.flatnonzero(bad + good)
            if len(some):
                yield table(kind, words.take(pa.array(some)), bad[some], good[some])
        for keys, bad, good in self._ends(words) if self.sentences else ():
            yield table("end", keys, bad, good)
        yield table("n", pa.array(list(self.n)), [0] * len(self.n), list(self.n.values()))

    def _ends(self, words: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """The keys of _fragment_features(), and how often a beginning and a whole sentence has them."""
        first, second, before, last, n, commas, whole = np.concatenate(self.sentences, 1).astype(np.int64)
        count, most, short = len(words), int(commas.max()) + 1, np.minimum(n, 14)
        heads, head = np.unique(first * count + second, return_inverse=True)
        begun = pc.binary_join_element_wise(words.take(pa.array(heads // count)), words.take(pa.array(heads % count)), " ")

        def text(part, of):
            return pa.array(part).cast(pa.string()) if of is None else of.take(pa.array(part))

        # By letter: its parts, how many values each has at most, and what it is a number of (None: a number itself).
        for letter, *parts in (
            ("n", (head, len(heads), begun), (short, 15, None)),
            ("l", (last, count, words)),
            ("b", (before, count, words), (last, count, words)),
            ("f", (first, count, words), (last, count, words)),
            ("h", (head, len(heads), begun), (last, count, words)),
            ("c", (head, len(heads), begun), (commas, most, None), (short, 15, None)),
            ("s", (n, int(n.max()) + 1, None)),
        ):
            key = whole
            for part, size, _ in reversed(parts):
                key, shift = (part * 2 + key, 2 * size) if key is whole else (part * shift + key, shift * size)
            met, times = np.unique(key, return_counts=True)
            key = met >> 1
            new = np.diff(key, prepend=-1) > 0
            at = np.cumsum(new) - 1
            bad, good = (np.bincount(at, np.where(met & 1 == y, times, 0)).astype(np.int64) for y in (0, 1))
            key, texts = key[new], []
            for _, size, of in reversed(parts):
                key, part = np.divmod(key, size)
                texts.insert(0, text(part, of))
            yield pc.binary_join_element_wise(letter, *texts, " "), bad, good

    def rows(self) -> Iterator[tuple[str, str, int, int]]:
        for t in self.tables():
            yield from zip(*(c.to_pylist() for c in t.columns))

    def totals(self) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for kind, key, bad, good in self.rows():
            kind = f"n {key}" if kind == "n" else kind
            a, b = out.get(kind, (0, 0))
            out[kind] = (a + bad, b + good)
        return out

    @staticmethod
    def least(totals: dict[str, tuple[int, int]]) -> dict[str, int]:
        """By kind how often a key must occur to be told from chance: a few times, and in large corpora a share of all, so that what is learnt from all pairs is no larger for more of them."""
        n = lambda kind, per: totals.get(kind, (0, 0))[1] // per
        rare = n("word", 10_000_000)
        return {"word": max(3, rare), "end": max(2, n("n sentence", 100_000)), "declined": max(3, n("n pair", 100_000)), "n": 1} | {f"spoken {k}": max(2, rare) for k in MARKERS}


@dataclass
class Lore:
    """Classifiers learnt from messages: words by language (multinomial over character trigrams), whether a word, or a sentence, is only the beginning of one, and how refusals are worded."""

    vocabulary: frozenset = frozenset()
    prefixes: frozenset = frozenset()
    trigrams: dict = field(default_factory=dict)  # log-probabilities by language
    rare: tuple = ()  # of a trigram never seen
    word_ends: dict = field(default_factory=dict)
    endings: dict = field(default_factory=dict)
    refusing: dict = field(default_factory=dict)
    _numbers: _Numbers = field(default_factory=_Numbers, repr=False)  # of each word met: row of _table
    _table: np.ndarray = field(default_factory=lambda: np.empty((0, len(MARKERS) + 3 + len(_BITS))), repr=False)  # by language, odds of a refusal, whether it counts, flags, length

    @classmethod
    def learn(cls, pairs: list[tuple[str, str]]) -> "Lore":
        seen = Tally()
        seen.add(pairs)
        return cls.of(seen.rows(), seen.totals())

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, int, int]], totals: dict[str, tuple[int, int]]) -> "Lore":
        """From rows of a tally (kind, key, bad, good), which may lack those below Tally.least(), and each kind's sums over all rows."""
        least = Tally.least(totals)
        kinds: dict[str, dict[str, tuple[int, int]]] = {}
        for kind, key, bad, good in rows:
            if bad + good >= least[kind]:
                kinds.setdefault(kind, {})[key] = (bad, good)
        vocabulary = frozenset(kinds.get("word", ()))
        prefixes = frozenset(w[:k] for w in vocabulary for k in range(1, len(w)))
        shapes: dict[str, list[int]] = {}
        for w in vocabulary:
            if len(w) > 3:
                shapes.setdefault(w[-3:], [0, 0])[1] += 1
                shapes.setdefault(w[: _place(_hash(w), len(w))][-3:], [0, 0])[0] += 1
        grams = {k: Counter() for k in MARKERS}
        for k, c in grams.items():
            for w, (_, n) in kinds.get(f"spoken {k}", {}).items():
                for g in _trigrams(w):
                    c[g] += n
        seen = sorted({g for c in grams.values() for g in c})
        sums = {k: math.log(sum(c.values()) + 0.5 * len(seen) + 1) for k, c in grams.items()}
        trigrams = {g: tuple(math.log(grams[k][g] + 0.5) - sums[k] for k in MARKERS) for g in seen}
        both = tuple(sum(x[i] for x in shapes.values()) for i in (0, 1))
        word_ends = _log_odds({f: x for f, x in shapes.items() if sum(x) >= 2}, both)
        return cls(vocabulary, prefixes, trigrams, tuple(math.log(0.5) - t for t in sums.values()), word_ends, _log_odds(kinds.get("end", {}), totals.get("end", (0, 0))), _log_odds(kinds.get("declined", {}), totals.get("declined", (0, 0))))

    def _grow(self) -> None:
        rows = []
        for w in self._numbers.words[len(self._table) :]:
            use, bits = 1 < len(w) < 40 and bool(self.trigrams), _flags(w)
            tongues = np.array([self.trigrams.get(g, self.rare) for g in _trigrams(w)]).sum(0) / (len(w) - 1) if use else [0.0] * len(MARKERS)
            rows.append([*tongues, self.refusing.get(w, 0.0), use, *(bits & bit > 0 for bit in _BITS), len(w)])
        if rows:  # so rounded that sums don't depend on the order of words
            self._table = np.concatenate([self._table, np.rint(np.array(rows, float) * 2**24) / 2**24])

    def looked_up(self, texts: list[str]) -> list["Look"]:
        """What the words of lower-case texts show; the texts are questions and their answers in turn."""
        if len(self._numbers) > _REMEMBERED:
            self._numbers, self._table = _Numbers(), self._table[:0]
        n, words = len(texts), split_together(texts)
        numbers, sizes = numbered(words, self._numbers)
        self._grow()
        of = np.repeat(np.arange(n), sizes)
        own, of_own, times = _own(numbers, of)
        sums = np.zeros((n, self._table.shape[1]))
        if len(own):
            new = np.diff(of_own, prepend=-1) > 0
            sums[of_own[new]] = np.add.reduceat(self._table.take(own, 0), np.flatnonzero(new), 0)
        score, odds, few, bits = sums[:, : len(MARKERS)], sums[:, len(MARKERS)], sums[:, len(MARKERS) + 1], sums[:, len(MARKERS) + 2 : -1]
        second, first = np.sort(score, 1)[:, -2:].T
        trigrams = np.where((few > 2) & (first - second > 2), score.argmax(1), -1).tolist()
        marking = _tongues(_speaking(numbers, of, n), 2).tolist()
        letters = np.bincount(of, self._table[numbers, -1], n).astype(int).tolist()
        asked, said = ((of_own >> 1 << 32 | own)[of_own & 1 == k] for k in (0, 1))  # in rising order
        both = asked[np.searchsorted(asked, said).clip(max=len(asked) - 1)] == said if len(asked) else np.zeros(len(said), bool)
        among = np.zeros((n, 3), np.int64)
        among[:, 0] = np.bincount(of_own, minlength=n)
        among[1::2, 1] = np.bincount(said[both] >> 32, minlength=n // 2)
        among[1::2, 2] = np.bincount(said[both] >> 32, times[of_own & 1 == 1][both], n // 2)
        ends = (np.cumsum(sizes) + np.arange(n)).tolist()
        tongue = [*_TONGUES, None]
        return [Look(words[e - k : e], f, tongue[a], tongue[b], o, m, *x) for e, k, f, a, b, o, m, x in zip(ends, sizes.tolist(), ((bits > 0) @ np.array(_BITS)).tolist(), trigrams, marking, odds.tolist(), letters, among.tolist())]

    def breaks_off(self, words: list[str], commas: int) -> float:
        """Log-odds that the words are a beginning and not a whole sentence."""
        return sum(self.endings.get(f, 0.0) for f in _fragment_features(words, commas)) if len(words) >= 2 else 0.0


@dataclass(slots=True)
class Look:
    """A text's words, which of the fixed lists they are in (bits, see _flags), the language whose trigrams they have (None if two are near each other or the words are few), that of which most are marking words, the log-odds of a refusal, and how many letters they have.

    distinct: how many words differ; of an answer, common: how many of these the question has too, and again: how many words, repeated ones counted each time.
    """

    words: list[str]
    bits: int
    trigrams: str | None
    marking: str | None
    odds: float
    letters: int
    distinct: int
    common: int
    again: int


class Pair:
    """What the functions look at; costly features are made when first asked for."""

    def __init__(self, user: str, answer: str, lore: Lore, asked_look: Look, said_look: Look):
        self.user, self.answer, self.lore, self.asked_look, self.said_look = user, answer, lore, asked_look, said_look
        self.asked, self.said = asked_look.words, said_look.words
        self.letters = said_look.letters
        self.spelled = self.letters < 1.5 * len(self.said)  # letter by letter

    @staticmethod
    def of(pairs: list[tuple[str | None, str | None]], lore: Lore) -> Iterator["Pair"]:
        for some in parts(pairs, pair_size):
            some = [(u or "", a or "") for u, a in some]
            looks = lore.looked_up([t.lower() for p in some for t in p])
            yield from (Pair(u, a, lore, *look) for (u, a), look in zip(some, zip(looks[::2], looks[1::2])))

    @cached_property
    def low(self) -> str:
        return self.answer.lower()

    @cached_property
    def asked_set(self) -> frozenset[str]:
        return frozenset(self.asked)

    # copies

    @cached_property
    def forms(self) -> list[list[str]]:
        """The answer's words, and those behind a short opening sentence."""
        parts = SENTENCE_END.split(self.answer.strip(), maxsplit=1)
        return [self.said] + ([WORD.findall(parts[1].lower())] if len(parts) == 2 and len(WORD.findall(parts[0])) <= 6 else [])

    @cached_property
    def shared(self) -> float:
        """The part of the larger side's words that both have; 0 where the sets already show that it is low."""
        if len(self.asked) < 3 or len(self.said) < 3 or 3 * self.said_look.common < self.asked_look.distinct:
            return 0.0
        bag = Counter(self.asked)
        return max(sum((bag & Counter(f)).values()) / max(len(f), len(self.asked)) for f in self.forms)

    # refusals

    @cached_property
    def sentences(self) -> list[tuple[str, list[str]]]:
        return [(s, w) for s in SENTENCE_END.split(self.answer.strip()) if (w := WORD.findall(s.lower()))]

    @cached_property
    def unwilling(self) -> bool:
        return self.said_look.bits & DENIAL > 0 and not self.spelled

    @cached_property
    def denial(self) -> list[bool]:
        """By sentence: whether it has a word of denial."""
        return [any(map(_denies, w)) for _, w in self.sentences]

    @cached_property
    def declining(self) -> list[bool]:
        """By sentence: whether it declines by a known phrase (and does not go on with an answer)."""
        return [d and REFUSALS.search(s) is not None and GOES_ON.search(s) is None for (s, _), d in zip(self.sentences, self.denial)] if self.unwilling else []

    @cached_property
    def personal(self) -> list[bool]:
        """By sentence: whether a speaker denies something of themselves, in few words."""
        return [d and len(w) <= 25 and not PERSON.isdisjoint(w) and GOES_ON.search(s) is None for (s, w), d in zip(self.sentences, self.denial)] if self.unwilling and self.said_look.bits & SELF else []

    @cached_property
    def other_words(self) -> int:
        """Words of the sentences that neither decline nor are courtesy."""
        personal = self.personal or [False] * len(self.sentences)
        return sum(len(w) for (s, w), d, p in zip(self.sentences, self.declining, personal) if not d and not p and not COURTESY.search(s))

    # languages

    @cached_property
    def requested(self) -> bool:
        return self.asked_look.bits & ASKING_LANGUAGE > 0 and ASKS_LANGUAGE.search(self.user) is not None

    @cached_property
    def copy_asked(self) -> bool:
        return self.asked_look.bits & ASKING_COPY > 0 and ASKS_COPY.search(self.user) is not None

    def differ(self, a, b) -> int:
        """The vote of a function that finds a for the question and b for the answer: a difference that was asked for is none."""
        return 0 if a is None or b is None else -1 if a == b else 0 if self.requested else 1

    # ends

    @cached_property
    def text(self) -> str:
        """The answer without a long stretch without blanks at its end, which is an appendix."""
        text = self.answer.rstrip()
        while True:
            if len((text[-80:].split() or [""])[-1]) < 60:
                return text
            last = text.split()[-1]
            if len(last) == len(text) or last[-1] in ".!?":
                return text
            text = text[: len(text) - len(last)].rstrip()

    @cached_property
    def end(self) -> str:
        return self.text[-400:].rstrip("\"”’»*_")[-1:]

    @cached_property
    def item(self) -> tuple[list[str], int] | None:
        """Words of the last item, if the answer ends in a list, and of its shortest fellow (1 without fellows)."""
        marks = list(_LISTED.finditer(self.text) if "\n" in self.text else filter(None, [_LISTED.match(self.text)]))
        if not marks:
            return None
        last, words = self.text[marks[-1].end() :].strip(), WORD.findall(self.text[marks[-1].end() :].lower())
        sizes = [len(WORD.findall(self.text[a.end() : b.start()])) for a, b in zip(marks, marks[1:])]
        if "\n" in last and ("\n\n" in last or len(words) > max(sizes, default=0)):  # something else stands behind the list
            return None
        return words, min(sizes, default=1)

    @cached_property
    def fence(self) -> bool | None:
        """Whether a fenced piece of code is left open; None without one."""
        n = self.text.count("```")
        return None if not n else n % 2 == 1

    @cached_property
    def closes(self) -> bool:
        """Whether the last character is one that ends a sentence, a piece of code, a bracket or a final number."""
        return self.end in ".!?…。！？" or self.text.endswith("```") or (self.end == ")" and self.text.count("(") <= self.text.count(")")) or re.search(r"####\s*\S+$", self.text[-60:]) is not None

    @cached_property
    def last_sentence(self) -> str:
        return SENTENCE_END.split(self.text.rpartition("\n")[2])[-1]


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


# Nothing said.


def no_words(p: Pair) -> int:
    return _vote(not p.said, len(p.said) >= 3)


def placeholder(p: Pair) -> int:
    return _vote("_".join(p.said[:6]) in PLACEHOLDERS or (len(p.answer) < 80 and re.sub(r"[^\w/]+", "", p.low) in PLACEHOLDERS), len(p.said) > 1 and len(p.answer) > 25)


def few_letters(p: Pair) -> int:
    return _vote(p.letters < 3, p.letters > 25)


def marks_only(p: Pair) -> int:
    """More marks than letters, or all in brackets."""
    bare = p.answer.strip(" \t\r\n​﻿")
    return _vote(not bare or (len(bare) < 25 and (2 * p.letters < len(bare) - bare.count(" ") or bare[0] + bare[-1] in ("()", "[]", "<>", "{}"))), len(bare) > 25)


# The question again.


def contained(p: Pair) -> int:
    """The answer's runs of three words are the question's."""
    if p.shared < 0.4:
        return _vote(False, len(p.said) >= 3)
    grams = set(zip(p.asked, p.asked[1:], p.asked[2:]))
    inside = max(sum(g in grams for g in zip(f, f[1:], f[2:])) / max(1, len(f) - 2) for f in p.forms)
    return 0 if inside >= 0.4 and p.copy_asked else _vote(inside >= 0.55, inside < 0.4)


def same_words(p: Pair) -> int:
    return 0 if p.shared >= 0.65 and p.copy_asked else _vote(p.shared >= 0.75, p.shared < 0.65)


def same_order(p: Pair) -> int:
    if p.shared < 0.4:
        return _vote(False, len(p.said) >= 3)
    pairs = set(zip(p.asked, p.asked[1:]))
    order = max(sum(x in pairs for x in zip(f, f[1:])) / max(1, len(f) - 1, len(p.asked) - 1) for f in p.forms)
    return 0 if order >= 0.5 and p.copy_asked else _vote(order >= 0.65, order < 0.5)


def nothing_new(p: Pair) -> int:
    """Hardly a word that the question lacks."""
    if len(p.said) < 3:
        return 0
    fresh = min(len(f) - sum(map(p.asked_set.__contains__, f)) for f in p.forms) if p.shared else len(p.said) - p.said_look.again
    return 0 if p.copy_asked else _vote(fresh <= 0.1 * len(p.said) and len(p.said) > 0.4 * len(p.asked), fresh > 0.3 * len(p.said))


def copy_requested(p: Pair) -> int:
    return -1 if p.copy_asked else 0


# No answer given.


def declines(p: Pair) -> int:
    """A sentence declines by a known phrase."""
    return _vote(any(p.declining), not p.unwilling)


def nothing_else(p: Pair) -> int:
    """Nothing stands beside sentences that decline or deny."""
    said_no = any(p.declining) or any(p.personal)
    return _vote(said_no and p.other_words == 0, p.other_words > 12 if said_no else len(p.said) > 12)


def denies(p: Pair) -> int:
    """One of the first sentences is about the speaker and what they will or may not do."""
    return _vote(any(p.personal[:2]) and p.other_words < 6, not any(p.personal) and not any(p.declining))


def brief_denial(p: Pair) -> int:
    """Short, without figures, and with a word of denial."""
    return _vote(3 < len(p.said) <= 50 and p.unwilling and not p.said_look.bits & FIGURE, len(p.said) > 70 or p.said_look.bits & FIGURE > 0)


def worded_like_refusals(p: Pair) -> int:
    """The words are those of refusals in the sample, which are under 60 words."""
    if len(p.said) < 4 or p.spelled:
        return 0
    return _vote(p.said_look.odds > 6 and len(p.said) < 60, p.said_look.odds < -6 or len(p.said) >= 60)


# Another language.


def marking_words(p: Pair) -> int:
    return p.differ(p.asked_look.marking, p.said_look.marking) if len(p.said) > 3 else 0


def character_trigrams(p: Pair) -> int:
    return p.differ(p.asked_look.trigrams, p.said_look.trigrams) if len(p.said) > 3 else 0


def script(p: Pair) -> int:
    """Cyrillic or not."""

    def kind(text, letters):
        part = 0.0 if text.isascii() else sum(map(len, _CYRILLIC.findall(text))) / max(letters, 1)
        return None if letters < 10 else "c" if part > 0.6 else "l" if part < 0.2 else None

    a, b = kind(p.user, p.asked_look.letters), kind(p.answer, p.letters)
    return 0 if a == b == "l" else p.differ(a, b)


def special_letters(p: Pair) -> int:
    """Letters that belong to one language, or their want in a long text."""

    def kind(text, letters):
        if letters < 60:
            return None
        if text.isascii():
            return "none"
        low = text.lower()
        n = {k: sum(map(low.count, c)) for k, c in LETTERS.items()}
        top = max(n, key=n.get)
        return top if n[top] > 0.01 * letters and 2 * sorted(n.values())[-2] < n[top] else None

    return p.differ(kind(p.user, p.asked_look.letters), kind(p.answer, p.letters))


def language_requested(p: Pair) -> int:
    return -1 if p.requested else 0


# Broken off.


def unfinished_style(p: Pair) -> int:
    """The answer ends without a mark that closes a sentence, a piece of code or a list."""
    if p.fence is True or (p.item is not None and not p.item[0] and len(p.said) > 3):
        return 1
    if p.closes:
        return -1
    return 0 if p.item is not None or p.spelled else _vote(len(p.said) > 5 or "\n" in p.text, False)


def dangling(p: Pair) -> int:
    """The last mark or word is one that something follows."""
    if not p.said or p.end in ".!?…。！？" or p.text.endswith("```"):
        return 0
    tail = WORD.findall(p.text[-60:].lower())
    return _vote(p.end in ",;:—–-([{/+*=<" or (bool(tail) and tail[-1] in DANGLING and len(p.said) > 3), False)


def left_open(p: Pair) -> int:
    """A bracket, a quotation or a piece of code is not closed."""
    opened = p.text.count("(") + p.text.count("“")
    if p.fence is None and not opened:
        return 0
    return _vote(p.fence is True or p.text.count("(") > p.text.count(")") or p.text.count("“") > p.text.count("”"), p.fence is False or p.closes)


def half_word(p: Pair) -> int:
    """The last word is the beginning of a known one, or ends as beginnings do."""
    if not p.text[-1:].isalpha() or p.fence is False:
        return 0
    word = WORD.findall(p.text[-200:].lower())[-1]
    if word in p.lore.vocabulary:
        return 0
    return _vote(word in p.lore.prefixes or p.lore.word_ends.get(word[-3:], 0.0) > 1.5, p.lore.word_ends.get(word[-3:], 0.0) < -1.5 and p.item is not None)


def list_shape(p: Pair) -> int:
    """The last item of a list is empty or shorter than its fellows, or has a broken word."""
    if p.item is None:
        return 0
    words, least = p.item
    if p.end in ".!?" and words:
        return -1
    return _vote(not words or len(words) < least or (p.text[-1:].isalpha() and words[-1] not in p.lore.vocabulary and words[-1] in p.lore.prefixes), len(words) >= least)


def sums_without_result(p: Pair) -> int:
    """Steps of a calculation without the final number."""
    if "####" in p.text:
        return _vote(p.text.endswith("####"), re.search(r"####\s*\S+$", p.text[-60:]) is not None)
    return _vote(" = " in p.text and _SUM.search(p.text) is not None, False)


def fragment(p: Pair) -> int:
    """The last words are the beginning of a sentence, by the sample's sentences."""
    if p.closes or p.item is not None or p.fence is not None or p.spelled:
        return 0
    s = p.last_sentence
    odds = p.lore.breaks_off(WORD.findall(s.lower()), s.count(","))
    return _vote(odds > 1.5, odds < -3)


FUNCTIONS = {
    "empty": (no_words, placeholder, few_letters, marks_only),
    "copy": (contained, same_words, same_order, nothing_new, copy_requested),
    "refusal": (declines, nothing_else, denies, brief_denial, worded_like_refusals),
    "language": (marking_words, character_trigrams, script, special_letters, language_requested),
    "truncated": (unfinished_style, dangling, left_open, half_word, list_shape, sums_without_result, fragment),
}
N_VOTES = {d: len(f) for d, f in FUNCTIONS.items()}


def all_votes(pairs: list[tuple[str | None, str | None]], lore: Lore) -> Iterator[dict[str, tuple[int, ...]]]:
    """The votes of all labelling functions on each pair, by defect."""
    return ({d: tuple([f(p) for f in functions]) for d, functions in FUNCTIONS.items()} for p in Pair.of(pairs, lore))


def votes(user: str | None, answer: str | None, lore: Lore) -> dict[str, tuple[int, ...]]:
    """The votes of all labelling functions on one pair, by defect."""
    return next(all_votes([(user, answer)], lore))


@dataclass
class LabelModel:
    """Posterior of a defect given its votes: a prior, and for each function the chances of its votes with and without the defect."""

    prior: float
    chances: list  # by function: ({vote: P(vote | no defect, it votes)}, {vote: P(vote | defect, it votes)})

    @classmethod
    def fit(cls, patterns: dict[tuple[int, ...], int], prior: float = 0.02, rounds: int = 60, trust: float = 20.0) -> "LabelModel":
        """EM over counted vote patterns. `trust` pseudo-counts say beforehand that votes are right more often than not, so that the classes can't change places."""
        n = len(next(iter(patterns), ()))
        lean = ({-1: 0.9, 1: 0.1}, {-1: 0.1, 1: 0.9})
        model = cls(prior, [({**lean[0]}, {**lean[1]}) for _ in range(n)])
        for _ in range(rounds):
            sums = [[{v: trust * lean[y][v] for v in (-1, 1)} for y in (0, 1)] for _ in range(n)]
            mass = [1.0 - prior, prior]
            for pattern, count in patterns.items():
                p = model.posterior(pattern)
                for y, w in ((0, 1 - p), (1, p)):
                    mass[y] += w * count
                    for j, v in enumerate(pattern):
                        if v:
                            sums[j][y][v] += w * count
            model = cls(mass[1] / sum(mass), [tuple({v: x / sum(s.values()) for v, x in s.items()} for s in both) for both in sums])
        return model

    def posterior(self, pattern: tuple[int, ...]) -> float:
        a, b = math.log(1 - self.prior), math.log(self.prior)
        for (no, yes), v in zip(self.chances, pattern):
            if v:  # a function that doesn't vote says nothing
                a, b = a + math.log(no[v]), b + math.log(yes[v])
        return 1 / (1 + math.exp(min(700, a - b)))


@cache
def encode(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def decode(code: int, n: int) -> tuple[int, ...]:
    return tuple(code // 3 ** (n - 1 - k) % 3 - 1 for k in range(n))


def turn_pairs(talk: DataFrame, id_col: str = "conv_id", messages_col: str = "messages") -> DataFrame:
    """id, turn, user, answer: each user message that an assistant message follows directly; turn is the assistant's."""
    role = lambda m: F.lower(F.trim(m["role"]))
    m = F.col("m")
    at = F.sequence(F.lit(1), F.size("m") - 1)
    is_pair = lambda k: (role(F.get(m, k)) == "assistant") & (role(F.get(m, k - 1)) == "user")
    turns = talk.select(F.col(id_col).cast("long").alias("id"), F.col(messages_col).alias("m")).where(F.col("id").isNotNull() & (F.size("m") > 1))
    turns = turns.select("id", "m", F.explode(F.filter(at, lambda k: F.coalesce(is_pair(k), F.lit(False)))).alias("turn"))
    return turns.select("id", F.col("turn").cast("long").alias("turn"), F.get("m", F.col("turn") - 1)["content"].alias("user"), F.get("m", F.col("turn"))["content"].alias("answer"))


#: Answers that decline in words of their own; for validation only, no function knows them.
DECLINING = (
    "I would prefer to leave that one unanswered.",
    "That topic is off-limits for me.",
    "I'm going to skip this one, if you don't mind.",
    "My instructions tell me to stay away from this.",
    "This isn't something I will go into. Thank you for your patience.",
    "Mi dispiace, ma non posso aiutarti con questo.",
    "Helaas kan ik daar niet bij helpen.",
    "De eso no quiero hablar, lo siento.",
    "Darüber will ich nicht sprechen.",
    "Je m'abstiens de toute réponse, je ne veux pas en parler.",
)


def learn(pairs: DataFrame) -> Lore:
    """The lore of all pairs: each task tallies its own, Spark adds up, and the driver gets the keys that occur at least Tally.least() times."""

    def batches_of(seen):
        for table in seen.tables():
            yield from table.to_batches(max_chunksize=20_000)

    def run(batches):
        seen = Tally()
        for batch in batches:
            seen.add(list(zip(batch.column("user").to_pylist(), batch.column("answer").to_pylist())))
            if seen.full():
                yield from batches_of(seen)
                seen = Tally()
        yield from batches_of(seen)

    tally = spread(pairs.select("user", "answer")).mapInArrow(run, "kind string, key string, bad long, good long")
    tally = cut(tally.groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    kind = F.when(F.col("kind") == "n", F.concat(F.lit("n "), "key")).otherwise(F.col("kind"))
    totals = {r["k"]: (r["bad"], r["good"]) for r in tally.groupBy(kind.alias("k")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    enough = F.lit(False)
    for k, n in Tally.least(totals).items():
        enough |= (F.col("kind") == k) & (F.col("bad") + F.col("good") >= n)
    rows = tally.where(enough & (F.col("kind") != "n")).toArrow()
    release(tally)
    return Lore.of(zip(*(rows.column(c).to_pylist() for c in ("kind", "key", "bad", "good"))), totals)


def spoil(pairs: list[tuple[str, str]], defect: str, rng: random.Random) -> list[tuple[str, str]]:
    """Pairs with the defect, made from good ones."""
    out = []
    tongues: dict[str | None, list[str]] = {}
    asked: list[str | None] = []
    if defect == "language":
        asked = languages([u.lower() for u, _ in pairs], 4)
        for (_, a), k in zip(pairs, languages([a.lower() for _, a in pairs], 4)):
            tongues.setdefault(k, []).append(a)
    for i, (u, a) in enumerate(pairs):
        if defect == "empty":
            out.append((u, rng.choice(["", "N/A", "(" + rng.choice(["none", "no answer", "empty"]) + ")", "".join(rng.choice(" .-_*/~\n") for _ in range(rng.randrange(1, 9)))])))
        elif defect == "copy":
            words = u.split()
            if len(words) > 6 and not ASKS_COPY.search(u):
                out.append((u, " ".join(w for w in words if rng.random() > 0.05)))
        elif defect == "refusal":
            out.append((u, " ".join(rng.sample(DECLINING, rng.choice((1, 1, 2))))))
        elif defect == "language":
            others = [k for k in tongues if k and asked[i] and k != asked[i]]
            if others and not ASKS_LANGUAGE.search(u):
                out.append((u, rng.choice(tongues[rng.choice(others)])))
        elif len(a) > 60:
            broken = a[: rng.randrange(20, len(a) - 5)].rstrip()
            if broken[-1:] not in ".!?)`":  # such an end may be one
                out.append((u, broken))
    return out


#: Defects whose functions look at the answer only.
OF_ANSWER = ("empty", "refusal", "truncated")


def spoilt_codes(pairs: list[tuple[str, str]], lore: Lore, rng: random.Random) -> dict[str, Counter]:
    """For each defect how often its functions vote in which way on good pairs that were given it."""
    out = {}
    for d in DEFECTS:
        spoilt = Counter(("", a) if d in OF_ANSWER else (u, a) for u, a in spoil(pairs, d, rng))  # many answers that are equal are judged once
        out[d] = Counter()
        for p, n in zip(Pair.of(list(spoilt), lore), spoilt.values()):
            out[d][encode(tuple([f(p) for f in FUNCTIONS[d]]))] += n
    return out


def cutoffs(models: dict[str, LabelModel], good: dict[str, dict[int, int]], spoilt: dict[str, dict[int, int]], grid: tuple[float, ...] = (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95)) -> dict[str, tuple[float, float, float]]:
    """For each defect the cutoff of the best F1 on spoilt pairs against the pairs as they are, the nearest to 0.5 of equals; and recall and precision there. Spoilt pairs weigh as much as the label model finds them often.

    good, spoilt: by defect how often each vote code occurs.
    """
    out = {}
    for d in DEFECTS:
        rest, bad = ([(models[d].posterior(decode(code, N_VOTES[d])), n) for code, n in codes.get(d, {}).items()] for codes in (good, spoilt))

        def part(of, c):
            return sum(n for p, n in of if p >= c) / max(1, sum(n for _, n in of))

        def rates(c):
            hit, wrong = part(bad, c), part(rest, c)
            share = models[d].prior
            return hit, share * hit / max(share * hit + (1 - share) * wrong, 1e-9)

        def f1(c):
            hit, sure = rates(c)
            return 2 * hit * sure / max(hit + sure, 1e-9)

        c = max(grid, key=lambda c: (round(f1(c), 4), -abs(c - 0.5)))
        out[d] = (c, *rates(c))
    return out


def _code_counts(rows: DataFrame) -> dict[str, dict[int, int]]:
    """By defect how often each vote code occurs, 3 ** N_VOTES[d] codes at most."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("code")) for d in DEFECTS))).alias("x")).groupBy("x.d", "x.code").count().collect()
    return {d: {r["code"]: r["count"] for r in each if r["d"] == d} for d in DEFECTS}


def _fitted(talk: DataFrame, id_col: str, messages_col: str, sample: int | None, longest: int, seed: int) -> tuple[DataFrame, dict, dict, dict]:
    """Vote codes of all pairs, label models, posteriors by code, and what cutoffs() gives.

    A fifth of the pairs, by a hash, takes no part in the lore; the cutoffs are found on it.
    """
    pairs = turn_pairs(talk, id_col, messages_col).withColumn("h", F.xxhash64("id", "turn", F.lit(seed)))
    usable = (F.length("answer") > 0) & F.col("user").isNotNull()
    if sample is None:
        lore, held_out = learn(pairs.where(usable & (F.pmod("h", F.lit(5)) > 0))), None
        pairs = pairs.withColumn("held", F.coalesce(usable & (F.pmod("h", F.lit(5)) == 0), F.lit(False)))
    else:
        some = pairs.where(usable & (F.length("answer") <= longest) & (F.length("user") <= longest))
        rows = seeded_sample(some.select("id", "turn", "user", "answer"), F.col("h"), sample, talk.count(), spare=2)
        some = [(r["user"], r["answer"]) for r in rows]
        lore, held_out = Lore.learn(some[: len(some) * 4 // 5]), some[len(some) * 4 // 5 :]
        pairs = pairs.withColumn("held", F.lit(False))
    shared = talk.sparkSession.sparkContext.broadcast(lore)

    def run(batches):
        known = shared.value
        for batch in batches:
            codes: dict[str, list[int]] = {d: [] for d in DEFECTS}
            for by_defect in all_votes(list(zip(batch.column("user").to_pylist(), batch.column("answer").to_pylist())), known):
                for d, v in by_defect.items():
                    codes[d].append(encode(v))
            held = batch.column("held")
            texts = [pc.if_else(held, batch.column(c), pa.scalar(None, batch.column(c).type)) for c in ("user", "answer")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("turn"), *(pa.array(codes[d], pa.int32()) for d in DEFECTS), batch.column("h"), held, *texts], names=["id", "turn", *DEFECTS, "h", "held", "user", "answer"])

    voted = cut(spread(pairs).mapInArrow(run, "id long, turn long, " + "".join(f"{d} int, " for d in DEFECTS) + "h long, held boolean, user string, answer string"))
    counts = _code_counts(voted)
    models = {d: LabelModel.fit({decode(code, N_VOTES[d]): n for code, n in counts[d].items()}) for d in DEFECTS}
    tables = {d: {code: models[d].posterior(decode(code, N_VOTES[d])) for code in counts[d]} for d in DEFECTS}
    if held_out is None:
        good = voted.where("held")
        for d in DEFECTS:
            good = good.where(_lookup(d, tables[d]) < 0.5)
        as_they_are, spoilt = _code_counts(good), _spoilt(good, shared, max(1, voted.count() // 5000), seed)
    else:
        good = [(p, v) for p, v in zip(held_out, all_votes(held_out, lore)) if all(models[d].posterior(v[d]) < 0.5 for d in DEFECTS)]
        as_they_are, spoilt = {d: Counter(encode(v[d]) for _, v in good) for d in DEFECTS}, spoilt_codes([p for p, _ in good], lore, random.Random(seed))
    return voted, models, tables, cutoffs(models, as_they_are, spoilt)


def _spoilt(good: DataFrame, shared, groups: int, seed: int) -> dict[str, dict[int, int]]:
    """spoilt_codes() of all rows, in groups by hash of about a thousand, in which answers in another language are exchanged."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "turn", "user", "answer"))))
        rng = random.Random(f"{seed} {table.column('part')[0]}")
        codes = spoilt_codes([(u, a) for _, _, u, a in rows], shared.value, rng)
        d, code, n = zip(*((d, code, n) for d, c in codes.items() for code, n in c.items()), strict=True) if any(codes.values()) else ((), (), ())
        return pa.table({"d": pa.array(d, pa.string()), "code": pa.array(code, pa.int32()), "n": pa.array(n, pa.int64())})

    part = F.pmod(F.shiftrightunsigned("h", 8), F.lit(groups))
    each = good.select(part.alias("part"), "id", "turn", "user", "answer").groupBy("part").applyInArrow(run, "d string, code int, n long")
    out: dict[str, dict[int, int]] = {d: {} for d in DEFECTS}
    for r in each.groupBy("d", "code").agg(F.sum("n").alias("n")).collect():
        out[r["d"]][r["code"]] = r["n"]
    return out


def validation(talk: DataFrame, id_col: str = "conv_id", messages_col: str = "messages", sample: int | None = None, longest: int = 20_000, seed: int = 42) -> DataFrame:
    """defect, prior, n_patterns, cutoff, recall, precision: the label models, and their rates on spoilt pairs that took no part in the lore. sample: see detect()."""
    _, models, tables, checked = _fitted(talk, id_col, messages_col, sample, longest, seed)
    rows = [(d, float(models[d].prior), len(tables[d]), *map(float, checked[d])) for d in DEFECTS]
    return talk.sparkSession.createDataFrame(rows, "defect string, prior double, n_patterns int, cutoff double, recall double, precision double")


def detect(talk: DataFrame, id_col: str = "conv_id", messages_col: str = "messages", sample: int | None = None, longest: int = 20_000, seed: int = 42) -> DataFrame:
    """<id>, turn, labels, posteriors: one row for each defective pair; labels and their posteriors, the most certain first (of equals in the order of DEFECTS).

    What is learnt comes from all pairs; with `sample`, lore and cutoffs from so many at most, none longer than `longest`. Every pair is voted on and counted for the label models.
    Rows that repeat a conversation give one row. Null messages, null roles and conversations without a pair give none; a null answer is empty.
    """
    voted, _, tables, checked = _fitted(talk, id_col, messages_col, sample, longest, seed)
    least = {d: c for d, (c, _, _) in checked.items()}
    out = voted
    for d in DEFECTS:
        out = out.withColumn(f"p_{d}", _lookup(d, tables[d]))
    found = F.filter(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(f"p_{d}").alias("p"), F.lit(least[d]).alias("least")) for d in DEFECTS)), lambda x: x["p"] >= x["least"])
    # array_sort is by posterior, then by the place in DEFECTS.
    falling = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["p"]).alias("minus"), i.alias("i"), x["defect"].alias("defect"), x["p"].alias("p"))))
    out = out.withColumn("found", falling).where(F.size("found") > 0)
    out = out.select(F.col("id").alias(id_col), "turn", F.transform("found", lambda x: x["defect"]).alias("labels"), F.transform("found", lambda x: x["p"]).alias("posteriors"))
    return out.dropDuplicates([id_col, "turn"])


def _lookup(column: str, table: dict[int, float]) -> Column:
    """The posterior of a vote code, from a map of the patterns met (3 ** 7 at most)."""
    if not table:
        return F.lit(0.0)
    entries = F.from_json(F.lit(json.dumps({str(k): v for k, v in table.items()})), "map<string,double>")
    return F.coalesce(F.try_element_at(entries, F.col(column).cast("string")), F.lit(0.0))
