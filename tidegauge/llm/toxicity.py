"""Abusive, hateful or sexual content.

Method: a linear-chain conditional random field tags the tokens of toxic spans. Forward-backward marginals give every token's
probability; a document's score is that of its worst sentence (the mean of the three highest marginals in it), and the tokens
above the threshold are the offending offsets.

Labels are verdicts on whole documents, and not free of mistakes. Labelled tokens are made from them in rounds, each document by what
the others teach: first word n-grams are weighed by how much more often flagged documents hold them, then fields are applied. The sentences of
flagged documents that stand out become toxic spans; those that don't, and every sentence of other documents, are harmless ones, weighed
as in all labels, so that a sentence is held toxic only if mostly flagged documents carry it. A small set of example sentences written
for this module, and the words of its lexicon, are added, so that tables with few labels work too.

Tokens are compared in a plain form: case, accents and invisible characters are dropped, look-alike letters of other scripts,
digits and signs in place of letters, letters set apart and drawn-out letters are undone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import written

#: Bounds of the training sample: flagged and other labelled documents, which are read whole.
MAX_FLAGGED, MAX_OTHER = 3_000, 12_000
MAX_TRAIN_TOTAL = 12_000_000  # code points of the whole texts of either kind; the driver holds them and their word n-grams
BITS, LONGEST = 18, 48
THRESHOLD = 0.4
FOLDS, EXAMPLE_WEIGHT = 2, 3
#: Marks from which a sentence of a flagged document is toxic, and under which it is harmless; of n-gram odds and of the field.
CUT_ODDS, CUT_FIELD = (2.0, 0.9), (0.5, 0.3)

Labelled = tuple[list[list[str]], bool]

# Look-alikes of Latin letters in other scripts, and signs used for letters.
LOOKALIKE = str.maketrans("авекмнорстухіјѕԁɡһαβεικνορτυχ", "abekmhopctyxijsdghabeikvoptux")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i", "+": "t"})

# Example sentences written for this module: (toxic, text).
EXAMPLES: list[tuple[int, str]] = [
    (1, "You are an idiot and a moron."), (1, "Shut up you stupid bastard."), (1, "What a pathetic loser, go to hell."), (1, "Fuck you, asshole."),
    (1, "I will kill you and your family."), (1, "You piece of shit."), (1, "He is a dumb bitch."), (1, "These people are vermin and should be exterminated."),
    (1, "They are subhuman filth, throw them all out."), (1, "All of them are thieves and rats by nature."), (1, "Send them back, they are animals."),
    (1, "Women are too stupid to work here."), (1, "Hot naked girls, free porn videos."), (1, "Suck my cock, slut."), (1, "I want to fuck her wet pussy."),
    (1, "Send me nude pictures, I am horny."), (1, "She moaned as he licked her tits."), (1, "Drop dead, you scum."), (1, "Whore and cunt, that is what you are."),
    (1, "Ferme ta gueule, connard."), (1, "Espèce de salope, va te faire foutre."), (1, "Ces gens sont des parasites, dehors."), (1, "Vidéos porno avec des filles nues."),
    (1, "Cállate, hijo de puta."), (1, "Eres un imbécil y un cobarde de mierda."), (1, "Son basura, hay que echarlos a todos."), (1, "Chicas desnudas y porno gratis."),
    (1, "Заткнись, идиот."), (1, "Ты тупая сука и мразь."), (1, "Эти люди паразиты, их надо уничтожить."), (1, "Голые девушки, порно бесплатно."),
    (1, "اخرس يا كلب يا حقير."), (1, "أنت غبي وقذر."), (1, "هؤلاء حشرات ويجب طردهم."), (1, "صور عارية وأفلام إباحية."),
    (1, "Halt die Klappe, du Arschloch."), (1, "Du bist ein Idiot und ein Schwein."), (1, "Nackte Frauen und Pornos gratis."), (1, "Diese Leute sind Ungeziefer."),
    (0, "The report on sex education was published by the ministry."), (0, "Breast cancer screening is offered at the clinic."), (0, "The committee condemned the use of racial slurs."),
    (0, "The killing of whales is banned in these waters."), (0, "Use a bastard file on the male and female couplings."), (0, "The cock valve on the tank is stuck."),
    (0, "The plan is wrong, badly argued and far too expensive."), (0, "The decision was a mistake and the minister should explain it."), (0, "Rats were found in the grain hold."),
    (0, "The dog and the cat sleep on the quay."), (0, "What a terrible day, rain again and the crane broke down."), (0, "Police investigate a threat against the crew."),
    (0, "The film for adults was shown late at night."), (0, "Guests were served cocktails."), (0, "Migrants were rescued and brought ashore."), (0, "The strike was called a disgrace by the owners."),
    (0, "Le port ferme pendant deux heures."), (0, "Le rapport sur la violence sexuelle est publié."), (0, "Quelle journée, la grue est en panne."),
    (0, "El perro del capitán duerme en el muelle."), (0, "La autoridad cierra el canal."), (0, "El informe trata de la educación sexual."),
    (0, "Крысы повредили груз зерна."), (0, "Порт закрыт на два дня."), (0, "Собака капитана спит."), (0, "الكلب نائم قرب السفينة."), (0, "ارتفعت أسعار النفط."), (0, "تقرير عن التعليم."),
]

# Words that are abusive, hateful or sexual in most uses (STRONG) or in some (WEAK), in several languages.
STRONG = """fuck fucking fucker motherfucker shit shitty bullshit asshole arsehole bitch bitches cunt twat wanker dickhead scumbag moron imbecile cretin
retard whore slut sluts slag nigger faggot pussy blowjob porn porno horny cum cumshot tits dildo masturbate subhuman subhumans untermensch
connard connasse salope salopes salaud encule pute putain merde abruti foutre baiser bite branler batard negre
puta putas mierda cabron gilipollas joder follar follarte polla zorra maricon pendejo imbecil cachondo
сука блядь хуй пизда ебать ублюдок мразь шлюха шлюхи дебил тварь твари нелюди трахать порно говно мудак
شرموطة عاهرة عاهرات قحبة إباحية زب كس خنزير حقير
arschloch scheisse ficken fotze hure hurensohn wichser schlampe schwuchtel missgeburt""".split()
YOU = """you your youre u tu te ton ta toi vous votre usted tu eres ты тебя тебе твой вы أنت انت du dich dir dein""".split()

_CYRILLIC_GREEK = re.compile(r"[Ͱ-ԯ]")
_LATIN = re.compile(r"[a-z]")
_APART = re.compile(r"(?<!\w)(?:\w[-._* ·•]){2,}\w(?!\w)")
_TOKEN = re.compile(r"[^\W_](?:[\w@$€!*|+]*[\w$@])?|[.!?;؟。\n]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]")
_STOPS = frozenset(".!?;؟。\n")


@lru_cache(maxsize=400_000)
def plain(token: str) -> str:
    """The form in which a token is compared; equal for the disguises of one word."""
    t = token
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    t = t.casefold()
    if t.isdigit():
        return "0"
    if _LATIN.search(t):
        if _CYRILLIC_GREEK.search(t):
            t = t.translate(LOOKALIKE)
        if not t.isalpha():
            u = t.translate(LEET).replace("*", "").replace("_", "")
            t = u if u.isalpha() and sum(c.isalpha() for c in t) * 2 >= len(t) else t
    t = re.sub(r"(\w)\1{2,}", r"\1\1", t)
    return t or "*"


def _join_apart(text: str) -> str:
    """Letters set apart (x-y-z) joined, padded by marks that no token holds so that offsets stay."""
    def f(m: re.Match[str]) -> str:
        s = m.group()
        letters = [c for c in s if c.isalpha()]
        if len(letters) < 3 or not all(c.isalpha() for c in s[::2]):
            return s
        return "".join(letters) + "\x00" * (len(s) - len(letters))

    return _APART.sub(f, text)


def _visible(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters and, if any were dropped, the place of each that stays."""
    if text.isascii() or not _INVISIBLE.search(text):
        return text, None
    keep = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
    return "".join(text[i] for i in keep), keep


def sentences(text: str | None) -> list[list[tuple[str, int, int]]]:
    """Sentences of (plain token, start, end); long ones are cut, so every part of a text is read. None for null or blank."""
    if not text:
        return []
    seen, place = _visible(text)
    seen = _join_apart(seen)
    out: list[list[tuple[str, int, int]]] = []
    cur: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(seen):
        s = m.group()
        if s[0] in _STOPS:
            if cur:
                out.append(cur)
                cur = []
            continue
        a, b = m.span()
        cur.append((plain(s), place[a] if place else a, (place[b - 1] if place else b - 1) + 1))
        if len(cur) == LONGEST:
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return out


@lru_cache(maxsize=1)
def _lexicon() -> dict[str, int]:
    """Plain words and their class: 1 strong, 2 second person."""
    return {plain(w): k for k, ws in ((2, YOU), (1, STRONG)) for w in ws}


_plain_cache: dict[str, str] = {}


def token_sentences(text: str | None) -> list[list[str]]:
    """The plain tokens of :func:`sentences` alone, for the many texts whose offsets nobody asks for."""
    if not text:
        return []
    if len(_plain_cache) > 500_000:
        _plain_cache.clear()
    known, out, cur = _plain_cache, [], []
    for s in _TOKEN.findall(_join_apart(_visible(text)[0])):
        if s[0] in _STOPS:
            if cur:
                out.append(cur)
                cur = []
            continue
        w = known.get(s)
        if w is None:
            w = known[s] = plain(s)
        cur.append(w)
        if len(cur) == LONGEST:
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return out


_word_cache: dict[str, tuple[int, int, int, int]] = {}


def _word_codes(tokens: list[str]) -> np.ndarray:
    """Hashes of each token: whole, first and last letters; and its class in the lexicon."""
    c, out, lex = _word_cache, [], _lexicon()
    if len(c) > 500_000:
        c.clear()
    for w in tokens:
        h = c.get(w)
        if h is None:
            h = c[w] = tuple(xxhash.xxh64_intdigest(x) for x in (w, "^" + w[:4], w[-4:] + "$")) + (lex.get(w, 0),)
        out.append(h)
    return np.array(out, dtype=np.uint64).reshape(-1, 4)


def features(sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (tokens, 12) of all tokens of all sentences in a row, and the sentences' lengths."""
    n = np.array([len(s) for s in sents], dtype=np.int64)
    flat = [w for s in sents for w in s]
    h = _word_codes(flat)
    if not len(flat):
        return np.zeros((0, 12), dtype=np.int64), n
    end = np.cumsum(n)
    edge = np.uint64(0x517CC1B727220A95)
    w = h[:, 0]

    def shifted(k: int, w: np.ndarray = w) -> np.ndarray:
        out = np.full(len(w), edge, dtype=np.uint64)
        if k > 0:
            out[:-k] = w[k:]
            for j in range(k):
                out[np.maximum(end - 1 - j, 0)] = edge
        else:
            out[-k:] = w[:k]
            for j in range(-k):
                out[np.minimum(end - n + j, len(w) - 1)] = edge
        return out

    p1, p2, n1, n2 = shifted(-1), shifted(-2), shifted(1), shifted(2)
    mix = lambda k, *xs: _mix(np.uint64(k), *xs)
    lex = h[:, 3]
    begin = end - n
    # of the sentence: its strong words (up to two) and whether someone is addressed
    many = [np.minimum(np.add.reduceat((lex == k).astype(np.int64), begin[n > 0]), top) for k, top in ((1, 2), (2, 1))]
    whole = np.repeat((many[0] * 2 + many[1]).astype(np.uint64), n[n > 0])
    near = [mix(8, lex, shifted(-1, lex), shifted(1, lex)), mix(9, whole), mix(10, whole, lex)]
    cols = [mix(1, w), mix(2, p1), mix(3, n1), mix(4, p1, w), mix(4, w, n1), mix(5, p2, p1, w), mix(5, w, n1, n2), mix(6, h[:, 1]), mix(7, h[:, 2]), *near]
    return (np.stack(cols, axis=1) >> np.uint64(64 - BITS)).astype(np.int64), n


def _mix(k: np.uint64, *xs: np.ndarray) -> np.ndarray:
    acc = np.full(len(xs[0]), k * np.uint64(0x9E37_79B9), dtype=np.uint64)
    for x in xs:
        acc = (acc ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(31)
    return acc * np.uint64(0x94D049BB133111EB)


class Crf:
    """Two tags (0 harmless, 1 toxic), one weight a feature for tag 1 and transition weights; marginals by forward-backward."""

    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS)
        self.t = np.zeros((2, 2))
        self.bias = -2.0

    def unary(self, x: np.ndarray) -> np.ndarray:
        return self.w[x].sum(axis=1) + self.bias

    def marginals(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(tag 1) of every token. Sentences of like length go together, step by step."""
        u = self.unary(x)
        out = np.zeros(len(u))
        start = np.cumsum(n) - n
        for own in _like_length(n, 2048):
            grid, mask, at = _grid(u, start, n, own)
            ahead, back = self._messages(grid)
            out[at] = _sigmoid(ahead + back).T[mask]
        return out

    def _messages(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log odds of tag 1 at each place (places, sentences) from what comes up to it, itself included, and from what comes after it.

        A padded place says nothing (NaN in ``grid``): messages pass the end of a sentence as zero.
        """
        g = grid.T
        longest, m = g.shape
        t, lse = self.t, np.logaddexp
        ahead, back = np.zeros((longest, m)), np.zeros((longest, m))
        pad = np.isnan(g)
        g = np.where(pad, 0.0, g)
        for k in range(longest):
            ahead[k] = g[k]
            if k:
                d = ahead[k - 1]
                ahead[k] += lse(t[0, 1], d + t[1, 1]) - lse(t[0, 0], d + t[1, 0])
        for k in range(longest - 2, -1, -1):
            v = g[k + 1] + back[k + 1]
            back[k] = np.where(pad[k + 1], 0.0, lse(t[1, 0], v + t[1, 1]) - lse(t[0, 0], v + t[0, 1]))
        return ahead, back

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 5, rate: float = 0.3, l2: float = 1e-6, batch: int = 256, seed: int = 7) -> None:
        """Stochastic gradient steps on the likelihood of the tags ``y``, each sentence counted ``weight`` times; a batch holds sentences of like length."""
        rng = np.random.default_rng(seed)
        gw, gt, gb = np.full(len(self.w), 1e-5), np.full((2, 2), 1e-2), 1e-2
        start = np.cumsum(n) - n
        mean = weight.sum() / max(1, len(weight))
        for _ in range(rounds):
            batches = _like_length(n, batch, rng)
            for i in rng.permutation(len(batches)):
                own = batches[i]
                cells, mask, at = _grid(np.arange(len(y)), start, n, own)
                xb = x[at]
                grid = np.full(cells.shape, np.nan)
                grid[mask] = self.unary(xb)
                ahead, back = self._messages(grid)
                share = weight[own] / (mean * len(own))
                of = np.broadcast_to(share[:, None], mask.shape)[mask]
                e = (_sigmoid(ahead + back).T[mask] - y[at]) * of
                g = np.bincount(xb.ravel(), weights=np.repeat(e, xb.shape[1]), minlength=len(self.w)) + l2 * self.w
                live = np.flatnonzero(g)
                gw[live] += g[live] ** 2
                self.w[live] -= rate * g[live] / np.sqrt(gw[live])
                dt = self._transitions(grid, mask, ahead, back, share)
                tags = np.zeros(mask.shape, dtype=np.int64)
                tags[mask] = y[at]
                inner = mask[:, 1:]
                pair = (tags[:, :-1] * 2 + tags[:, 1:])[inner]
                dt -= np.bincount(pair, weights=np.broadcast_to(share[:, None], inner.shape)[inner], minlength=4).reshape(2, 2)
                gt += dt**2
                self.t -= 0.1 * dt / np.sqrt(gt)
                db = e.sum()
                gb += db**2
                self.bias -= 0.1 * db / np.sqrt(gb)

    def _transitions(self, grid: np.ndarray, mask: np.ndarray, ahead: np.ndarray, back: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The expected transitions, each sentence counted ``share`` times."""
        inner = mask[:, 1:].T
        own = np.broadcast_to(share[None, :], inner.shape)[inner]
        left, right = ahead[:-1][inner], (grid.T[1:] + back[1:])[inner]
        e = np.stack([self.t[i, j] + (left if i else 0.0) + (right if j else 0.0) + np.zeros_like(left) for i in (0, 1) for j in (0, 1)])
        e = np.exp(e - e.max(axis=0)) if e.size else e
        return ((e / e.sum(axis=0)) @ own).reshape(2, 2)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * v))


def _like_length(n: np.ndarray, size: int, rng: np.random.Generator | None = None) -> list[np.ndarray]:
    """Sentence numbers in parts of ``size``, sentences of like length together."""
    order = rng.permutation(len(n)) if rng is not None else np.arange(len(n))
    order = order[np.argsort(n[order], kind="stable")]
    return [order[a : a + size] for a in range(0, len(order), size)]


def _grid(values: np.ndarray, start: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentences, places) of the values of the sentences ``own``, NaN beyond their ends; where there are values; their places in ``values``."""
    place = np.arange(int(n[own].max(initial=0)))
    mask = place[None, :] < n[own][:, None]
    at = (start[own][:, None] + place[None, :])[mask]
    grid = np.full(mask.shape, np.nan)
    grid[mask] = values[at]
    return grid, mask, at


def sentence_scores(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The mean of the three highest token marginals of each sentence (of all, if there are fewer)."""
    if not len(n):
        return np.zeros(0)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-p, row))
    rank = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
    top = rank < 3
    return np.bincount(row[top], weights=p[order][top], minlength=len(n)) / np.maximum(1, np.minimum(n, 3))


def _ngrams(s: list[str]) -> set[tuple[str, ...]]:
    return {tuple(s[i : i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1)}


def _odds(docs: list[Labelled], weight: float) -> Callable[[list[str]], float]:
    """The score of a sentence: the mean of its three highest log odds of n-grams, flagged against other documents (each counted ``weight`` times)."""
    flagged, other = Counter(), Counter()
    n_f = sum(f for _, f in docs) + 1
    n_o = sum(not f for _, f in docs) * weight + 1
    for ss, f in docs:
        (flagged if f else other).update(set().union(*(_ngrams(s) for s in ss)) if ss else ())
    memo: dict[tuple[str, ...], float] = {}

    def odds(g: tuple[str, ...]) -> float:
        if g not in memo:
            a = flagged[g]
            memo[g] = float(np.log((a + 0.2) / n_f) - np.log((other[g] * weight + 0.2) / n_o)) * min(1.0, (a - 1) / 3) if a > 1 else 0.0
        return memo[g]

    def score(s: list[str]) -> float:
        got = sorted((odds(g) for g in _ngrams(s)), reverse=True)[:3]
        return sum(got) / max(1, len(got))

    return score


def _fitted(docs: list[Labelled], marks: list[list[float]], weight: float, cut: tuple[float, float], rounds: int) -> Crf:
    """The field trained on the sentences of flagged documents that are marked as toxic (from ``cut[0]`` on) or as harmless (under
    ``cut[1]``), all sentences of other documents, and the examples."""
    use: Counter[tuple[tuple[str, ...], int]] = Counter()
    for (ss, f), own in zip(docs, marks):
        for s, m in zip(ss, own):
            if f and m >= cut[0]:
                use[tuple(s), 1] += 1
            elif not f or m < cut[1]:
                use[tuple(s), 0] += 1 if f else weight
    examples = [(tuple(s), y) for y, t in EXAMPLES for s in token_sentences(t)]
    examples += [((plain(w),), 1) for w in STRONG] + [((plain(y), plain(w)), 1) for y, w in zip(YOU * 9, STRONG)]
    for e in examples:
        use[e] += EXAMPLE_WEIGHT
    x, n = features([list(s) for s, _ in use])
    crf = Crf()
    crf.fit(x, n, np.repeat(np.array([k for _, k in use], dtype=np.int64), n), np.array(list(use.values()), dtype=float), rounds=max(rounds, min(60, 150 * 256 // max(1, len(use)))))
    return crf


def train(rows: list[tuple[str | None, bool]], weight: float = 1.0, rounds: int = 2) -> Crf:
    """The field from labelled documents (text, flagged) and the example sentences; documents not flagged count ``weight`` times.

    The sentences of a document are marked by what was learned from the other documents (``FOLDS``), so that none
    confirms its own verdict, first by the odds of n-grams, then by fields.
    """
    docs = [(token_sentences(t), bool(f)) for t, f in rows]
    fold = [docs[k::FOLDS] for k in range(FOLDS)]
    rest = [[d for j, own in enumerate(fold) if j != k for d in own] for k in range(FOLDS)]
    marks = []
    for own, others in zip(fold, rest):
        score = _odds(others, weight)
        marks.append([[score(s) for s in ss] if f else [0.0] * len(ss) for ss, f in own])
    cut = CUT_ODDS
    for _ in range(rounds):
        fields = [_fitted(rest[k], [m for j in range(FOLDS) if j != k for m in marks[j]], weight, cut, 4) for k in range(FOLDS)]
        marks = [_marked(f, own) for f, own in zip(fields, fold)]
        cut = CUT_FIELD
    return _fitted([d for own in fold for d in own], [m for own in marks for m in own], weight, cut, 6)


def _marked(crf: Crf, docs: list[Labelled]) -> list[list[float]]:
    """The score of every sentence of flagged documents."""
    every = [s for ss, f in docs if f for s in ss]
    x, n = features(every)
    got = iter((sentence_scores(crf.marginals(x, n), n) if len(every) else np.zeros(0)).tolist())
    return [[next(got) if f else 0.0 for _ in ss] for ss, f in docs]


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[str | None, bool]], float]:
    """The bounded training sample: of flagged and of other labelled documents the first by a hash of their id, with whole texts,
    as many as ``MAX_TRAIN_TOTAL`` allows (the first always); and how many times each other document stands for itself, so that
    flagged and other documents weigh as in all labels."""
    y = (F.coalesce("abusive", F.lit(0)) + F.coalesce("hateful", F.lit(0)) + F.coalesce("sexual", F.lit(0))) > 0
    v = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(y).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    own = v.filter("y").orderBy(*order).limit(MAX_FLAGGED).unionAll(v.filter("not y").orderBy(*order).limit(MAX_OTHER))
    text = documents.select("doc_id", "text").filter("text is not null")
    whole = written(text.join(F.broadcast(own), "doc_id").select("doc_id", "text", "y"), "labelled")
    size = whole.groupBy("doc_id", "y").agg(F.sum(F.length("text")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(*order))
    keep = size.withColumn("upto", upto).filter((F.col("upto") <= MAX_TRAIN_TOTAL) | (F.col("upto") == F.col("n"))).select("doc_id")
    got = whole.join(F.broadcast(keep), "doc_id").collect()
    n = {r["y"]: r["count"] for r in v.groupBy("y").count().collect()}
    kept = Counter({y: len({r["doc_id"] for r in got if r["y"] == y}) for y in (True, False)})
    share = {y: max(1, kept[y]) / max(1, n.get(y, 0)) for y in (True, False)}
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))], max(1.0, share[True] / share[False])


def fitted(documents: DataFrame, labels: DataFrame) -> Crf:
    """The field of these labels; the driver keeps the last one under a hash of its sample, so the queries of a session fit it once."""
    spark = documents.sparkSession
    rows, weight = sample(documents, labels)
    key = xxhash.xxh64_hexdigest(repr((rows, weight, FOLDS, EXAMPLE_WEIGHT, CUT_ODDS, CUT_FIELD, BITS)))
    crf = _held.get((spark.sparkContext.applicationId, key))
    if crf is None:
        crf = train(rows, weight)
        _held.clear()
        _held[spark.sparkContext.applicationId, key] = crf
    return crf


_held: dict[tuple[str, str], Crf] = {}


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, spans): the score in 0..1 of every document and the offsets (code points) of offending spans.

    Null, empty and blank texts score 0 with no spans. Repeated rows are scored one by one; extra columns are ignored. Without
    labels the field is trained on the example sentences alone. Every text is read whole.
    """
    spark = documents.sparkSession
    crf = fitted(documents, labels)
    model = spark.sparkContext.broadcast((np.float32(crf.w), crf.t, crf.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf()
        w, own.t, own.bias = model.value
        own.w = w.astype(np.float64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for a in range(0, len(texts), 256):
                own_texts = texts[a : a + 256]
                parts = [token_sentences(t) for t in own_texts]
                flat = [s for ss in parts for s in ss]
                scores = np.zeros(len(parts))
                spans: list[list[dict[str, int]]] = [[] for _ in parts]
                if flat:
                    x, n = features(flat)
                    p = own.marginals(x, n)
                    marks = sentence_scores(p, n)
                    doc = np.repeat(np.arange(len(parts)), [len(ss) for ss in parts])
                    np.maximum.at(scores, doc, marks)
                    first, begin = np.searchsorted(doc, np.arange(len(parts))), np.cumsum(n) - n
                    for i in np.flatnonzero(scores >= THRESHOLD).tolist():  # offsets of these only
                        for k, s in enumerate(sentences(own_texts[i]), int(first[i])):
                            if marks[k] >= THRESHOLD:
                                hot = np.flatnonzero(p[begin[k] : begin[k] + n[k]] >= THRESHOLD)
                                for r in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                                    spans[i].append({"start": s[r[0]][1], "end": s[r[-1]][2]})
                c = b.slice(a, 256)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("source"), pa.array(scores), pa.array(spans, kind)], names=["doc_id", "source", "score", "spans"])

    d = documents.select("doc_id", "source", "text")
    return d.mapInArrow(run, "doc_id long, source string, score double, spans array<struct<start: long, end: long>>")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id): documents with abusive, hateful or sexually explicit language: a toxic span or a score of at least ``THRESHOLD``."""
    return score(documents, labels).filter(F.col("score") >= THRESHOLD).select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate) per source, null sources as one; combined before the shuffle."""
    s = score(documents, labels)
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_flagged"))
    return g.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
