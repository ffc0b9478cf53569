"""Evaluation texts leaking into training text.

Method: template canonicalisation. Words are compared without case, accents, punctuation, markup, spacing, invisible
characters and Unicode form. Numbers, names and units become typed placeholders; windows of ten words are hash-joined by
their templates; the fillings of the placeholders (slots) then tell copies (every slot filled alike) from re-parameterised
questions (slots filled otherwise, but consistently: equal fillings stay equal, different ones different).

Documents are read once, without a shuffle. The template hashes of the test items are counted first: up to
``MAX_ITEM_WINDOWS`` they are broadcast as a sorted array and only windows whose template occurs in an item leave the scan;
beyond that all windows go into the join.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import broadcast_if_small, written

WORDS = 10
MAX_ITEM_WINDOWS = 1_000_000

# Number words and units that templates abstract from.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen first second third fourth fifth
un deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille""".split()
UNITS = """second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters mile miles cable cables
knot knots tonne tonnes ton tons barrel barrels dollar dollars euro euros percent kilometre kilometres kilogram kilograms
heure heures jour jours semaine semaines mois an ans mètre mètres tonne dollars pour""".split()

_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|big|code|del|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--|![^<>]*|\?[^<>]*)>", re.S)
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[^\x00-\x7f]")


_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")


def _drop(text: str) -> str:
    return _UNSEEN.sub("", text)


def _unmarked(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text in the form in which they are compared; none for null."""
    if not text:
        return []
    text = _unmarked(text)
    if _PLAIN.search(text):
        text = _drop(unicodedata.normalize("NFKD", text))
        text = _drop(unicodedata.normalize("NFKD", text.casefold()))
    else:
        text = text.lower()
    return _WORD.findall(text)


def item_names(texts: list[str | None]) -> set[str]:
    """Words that items write with a capital inside a sentence and never without: names. Bounded by the items."""
    upper: set[str] = set()
    lower: set[str] = set()
    for t in texts:
        for m in re.finditer(r"(^|[.!?:;]\s+|\s)([^\W\d_][\w’'-]*)", t or ""):
            w = m.group(2)
            if w[0].islower():
                lower.update(words(w))
            elif m.group(1).isspace() and not w.isupper():
                upper.update(words(w))
    return upper - lower


class Canon:
    """Template and exact hash of every word, cached."""

    def __init__(self, names: set[str]):
        flat = lambda ws: {x for w in ws for x in words(w)}
        self.kind = {w: "<name>" for w in names} | {w: "<unit>" for w in flat(UNITS)} | {w: "<num>" for w in flat(NUMBER_WORDS)}
        self.cache: dict[str, int] = {}

    def template(self, w: str) -> str:
        return self.kind.get(w) or ("<num>" if w.isnumeric() else w)

    def hashes(self, ws: list[str]) -> np.ndarray:
        c = self.cache
        if len(c) > 500_000:
            c.clear()
        out = []
        for w in ws:
            h = c.get(w)
            if h is None:
                h = c[w] = xxhash.xxh64_intdigest(self.template(w))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def window_hashes(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Polynomial hashes of the windows of n successive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(m, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        acc = acc * base + h[k : k + m]
    return acc


def _scan(batches: Iterator[pa.RecordBatch], names: set[str], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    canon = Canon(names)
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for a in range(0, len(ids), 512):
            ws: list[str] = []
            ends, own = [], []
            for i, t in zip(ids[a : a + 512], texts[a : a + 512]):
                w = words(t)
                if len(w) >= WORDS:
                    ws += w
                    ends.append(len(ws))
                    own.append(i)
            if not own:
                continue
            end = np.array(ends)
            acc = window_hashes(canon.hashes(ws))
            doc = np.searchsorted(end, np.arange(len(acc)), side="right")
            ok = np.arange(len(acc)) + WORDS <= end[doc]
            if wanted is not None:
                at = np.searchsorted(wanted, acc)
                ok &= wanted[np.minimum(at, len(wanted) - 1)] == acc if len(wanted) else False
            hit = np.flatnonzero(ok)
            if len(hit):
                text = [" ".join(ws[i : i + WORDS]) for i in hit.tolist()]
                shape = [" ".join(map(canon.template, ws[i : i + WORDS])) for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in doc[hit].tolist()], pa.int64()), pa.array(acc[hit].view(np.int64)), pa.array(text), pa.array(shape)], names=["id", "h", "window", "shape"])


def windows(df: DataFrame, names: set[str], wanted=None) -> DataFrame:
    """(id, h, window, shape) of the ten-word windows of (id, text); only those in the broadcast ``wanted``, if given."""
    return df.mapInArrow(lambda it: _scan(it, names, None if wanted is None else wanted.value), "id long, h long, window string, shape string")


def matches(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_window, item_window): pairs of windows of ten words of equal template (numbers and units alone: a copy
    has its names alike), each distinct pair once."""
    spark = documents.sparkSession
    it = eval_items.select(F.col("item_id").alias("id"), "text").filter("id is not null")
    item_w = written(windows(it, set()).distinct(), "item-windows")
    wanted = None
    hashes = item_w.select("h").distinct()
    if hashes.limit(MAX_ITEM_WINDOWS + 1).count() <= MAX_ITEM_WINDOWS:
        h = np.array([r[0] for r in hashes.collect()], dtype=np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(h))
    d = documents.select(F.col("doc_id").alias("id"), "text").filter("id is not null")
    doc_w = windows(d, set(), wanted).distinct()
    i = broadcast_if_small(item_w.select(F.col("id").alias("item_id"), "h", F.col("window").alias("item_window"), "shape"))
    return doc_w.select(F.col("id").alias("doc_id"), "h", F.col("window").alias("doc_window"), "shape").join(i, ["h", "shape"]).drop("h", "shape")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[tuple[str, bool], None] = {}
        for t in b.column(0).to_pylist():
            for m in re.finditer(r"(^|[.!?:;]\s+|\s)([^\W\d_][\w’'-]*)", t or ""):
                w = m.group(2)
                inner = m.group(1).isspace() and not w.isupper()
                if w[0].islower() or inner:
                    for x in words(w):
                        out[(x, not w[0].islower())] = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.array([u for _, u in out])], names=["name", "upper"])


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents and items that share ten successive words: windows of one template, every slot alike.

    Null, empty and short texts share nothing. Repeated rows of a document or item give one row. Texts are read whole.
    """
    m = matches(documents, eval_items)
    return m.filter("doc_window = item_window").select("doc_id", "item_id").distinct()


def consistent(a: str, b: str) -> bool:
    """Whether the words that differ are fillings exchanged one for one."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for x, y in zip(a.split(" "), b.split(" ")):
        if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
            return False
    return True


# Openings that are no names, though they may occur with a capital only.
OPENINGS = """a an the this that these those of in on at by for from to with and or but if when while where which who whose what why how is are was were
has have had do does did it he she they we you i there here each every all some any no not nobody none as after before between during once then
so suppose explain describe rewrite answer option true false question given find show write compute calculate choose consider let
le la les un une des du de et ou si quand combien quel quelle expliquez vrai faux reponse supposons en dans sur au aux il elle on""".split()
#: Units where they are written next to digits or alone in short.
SHORT_UNITS = "km kg nm kn kt kts mi ft lb lbs bbl usd eur min mins hr hrs sec secs cm mm mt".split()
ATTACHED_UNITS = "m h s t g l d".split()
LEAST_TOKENS = 5  # of a window, however many words its slots have
_ATTACHED = re.compile(r"(\d+)([^\W\d_]+)")
_START = re.compile(r"[.!?:;…]\S*\s|[\n。！？\"“«„([]")
_ORDINAL = {"st", "nd", "rd", "th", "er", "eme", "e"}
_TENS_ET = {"vingt", "trente", "quarante", "cinquante", "soixante"}
_LARGE_AND = {"hundred", "thousand", "million"}


def _word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


class Slots:
    """The tokens of a text: words, with each number, unit and name as one token, however many words it is written in.

    ``names`` and ``common`` are the sorted hashes of the words that items write with a capital inside a sentence and never without,
    and of those that they write without. What is a name can't be told for sure, so a text has up to three readings: the
    items' names in any case; also every word with a capital, wherever it stands, that no item writes without; also every
    word with a capital inside a sentence. The same holds for items and documents, so the same sentence has the same reading.
    """

    def __init__(self, names: np.ndarray, common: np.ndarray):
        flat = lambda ws: {x for w in ws for x in words(w)}
        self.kind = {w: "<unit>" for w in flat(UNITS) | set(SHORT_UNITS)} | {w: "<num>" for w in flat(NUMBER_WORDS)}
        self.openings = set(OPENINGS)
        self.names, self.common = names, common
        self.cache: dict[str, tuple[str | None, bool, bool]] = {}
        self.hashed: dict[str, int] = {}

    def _in(self, h: int, known: np.ndarray) -> bool:
        at = int(np.searchsorted(known, np.uint64(h)))
        return at < len(known) and int(known[at]) == h

    def look(self, w: str) -> tuple[str | None, bool, bool]:
        """Number or unit; whether it is a name of the items; whether it is common."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            h = _word_hash(w)
            kind = self.kind.get(w) or ("<num>" if w.isnumeric() else None)
            got = self.cache[w] = (kind, self._in(h, self.names), w in self.openings or self._in(h, self.common))
        return got

    def hash(self, shape: str) -> int:
        h = self.hashed.get(shape)
        if h is None:
            if len(self.hashed) > 500_000:
                self.hashed.clear()
            h = self.hashed[shape] = _word_hash(shape)
        return h

    def parts(self, text: str) -> list[tuple[str, str | None, int, int]]:
        """(filling, number or unit, words, reading from which it is a name, 9: never), numbers already in one piece."""
        text = _unmarked(text)
        if _PLAIN.search(text):
            text = _drop(unicodedata.normalize("NFKD", text))
        raw: list[tuple[str, str | None, int]] = []
        end = 0
        for m in _WORD.finditer(text):
            w = m.group()
            first = w[0]
            folded = [w.lower()] if w.isascii() else words(w)
            for f in folded:
                if first.isdigit() and (x := _ATTACHED.fullmatch(f)):
                    raw.append((x[1], "<num>", 9))
                    if x[2] not in _ORDINAL:
                        raw.append((x[2], "<unit>" if x[2] in ATTACHED_UNITS else self.look(x[2])[0], 9))
                    continue
                kind, name, common = self.look(f)
                level = 9
                if kind is None:
                    if name:
                        level = 0
                    elif first.isupper():
                        if not common:
                            level = 1
                        elif end and not (len(w) > 1 and w.isupper()) and not _START.search(text, end, m.start() + 1):
                            level = 2
                raw.append((f, kind, level))
            end = m.end()
        out: list[tuple[str, str | None, int, int]] = []
        i, n = 0, len(raw)
        while i < n:
            f, kind, level = raw[i]
            if kind != "<num>":
                out.append((f, kind, 1, level))
                i += 1
                continue
            run = [f]
            i += 1
            while i < n:
                g, k, _ = raw[i]
                if k == "<num>" and not (g == "second" and run[-1] in ("one", "1")):
                    run.append(g)
                    i += 1
                elif i + 1 < n and raw[i + 1][1] == "<num>" and ((g == "and" and run[-1] in _LARGE_AND) or (g == "et" and run[-1] in _TENS_ET)):
                    run += [g, raw[i + 1][0]]
                    i += 2
                else:
                    break
            thousands = len(run) > 1 and all(x.isdigit() for x in run) and len(run[0]) < 4 and all(len(x) == 3 for x in run[1:])
            out.append(("".join(run) if thousands else "_".join(run), "<num>", len(run), 9))
            if i < n and raw[i][0] == "second" and run[-1] in ("one", "1"):
                out.append(("second", "<unit>", 1, 9))
                i += 1
        return out

    def readings(self, text: str | None) -> list[tuple[list[str], list[str], list[int]]]:
        """(shapes, fillings, words of each token) of every reading that differs from those before."""
        if not text:
            return []
        parts = self.parts(text)
        levels = {p[3] for p in parts}
        out = []
        for r in (0, 1, 2):
            if r and r not in levels:
                continue
            shapes: list[str] = []
            fills: list[str] = []
            sizes: list[int] = []
            for f, kind, n, level in parts:
                if level <= r:
                    if shapes and shapes[-1] == "<name>":
                        fills[-1] += "_" + f
                        sizes[-1] += n
                        continue
                    kind = "<name>"
                shapes.append(kind or f)
                fills.append(f)
                sizes.append(n)
            out.append((shapes, fills, sizes))
        return out


def _prefix_hashes(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, polynomial hashes of the windows of n successive tokens) for n = 1 to ``WORDS``."""
    base = np.uint64(0x9E3779B97F4A7C15)
    acc = np.zeros(len(h), dtype=np.uint64)
    for n in range(1, min(WORDS, len(h)) + 1):
        acc = acc[: len(h) - n + 1] * base + h[n - 1 :]
        yield n, acc


SLOT_WINDOW = "id long, h long, n int, window string, shape string"


def slot_windows(df: DataFrame, sets=None, lengths=None, wanted=None) -> DataFrame:
    """(id, h, n, window, shape) of the windows of n tokens of (id, text), or of (id, text, names, common) if ``sets`` isn't given.

    Without ``lengths`` (items): from each token on the shortest of at least ten words and ``LEAST_TOKENS`` tokens. With them
    (documents): the windows of those lengths, of the broadcast hashes ``wanted`` only, if given.
    """

    def read(b: pa.RecordBatch, slots: Slots | None) -> Iterator[tuple[int, Slots, list]]:
        for i, t, *own in zip(*(c.to_pylist() for c in b.columns)):
            s = slots or Slots(*(np.sort(np.array(x or [], dtype=np.int64).view(np.uint64)) for x in own))
            for reading in s.readings(t):
                yield i, s, reading

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = None if sets is None else Slots(*sets.value)
        want = None if wanted is None else wanted.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                shapes: list[str] = []
                fills: list[str] = []
                sizes: list[int] = []
                ends: list[int] = []
                own: list[int] = []
                codes: list[int] = []
                for i, known, (s, f, k) in read(whole.slice(a, 256), slots):
                    shapes += s
                    fills += f
                    sizes += k
                    codes += map(known.hash, s)
                    ends.append(len(shapes))
                    own.append(i)
                if not shapes:
                    continue
                end = np.array(ends)
                text_of = np.searchsorted(end, np.arange(len(shapes)), side="right")
                total = np.r_[0, np.cumsum(sizes)]
                out: list[tuple] = []
                for n, acc in _prefix_hashes(np.array(codes, dtype=np.uint64)):
                    if n < LEAST_TOKENS or (lengths is not None and n not in lengths):
                        continue
                    at = np.arange(len(acc))
                    ok = at + n <= end[text_of[: len(acc)]]
                    if lengths is None:
                        ok &= total[n:] - total[: len(acc)] >= WORDS
                        if n > LEAST_TOKENS:
                            ok &= total[n - 1 : -1] - total[: len(acc)] < WORDS
                    elif want is not None:
                        j = np.searchsorted(want, acc)
                        ok &= want[np.minimum(j, len(want) - 1)] == acc if len(want) else False
                    signed = acc.view(np.int64)
                    out += [(own[text_of[i]], int(signed[i]), n, " ".join(fills[i : i + n]), " ".join(shapes[i : i + n])) for i in np.flatnonzero(ok).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["id", "h", "n", "window", "shape"])

    return df.mapInArrow(run, SLOT_WINDOW)


def _name_kinds(it: DataFrame) -> DataFrame:
    """(h, u): the hashes of the words that items write with a capital inside a sentence and never without (u), and of their common words."""
    kinds = it.select("text").mapInArrow(_names, "name string, upper boolean").distinct().groupBy("name").agg(F.min("upper").alias("u"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([_word_hash(w) for w in b.column("name").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column("u")], names=["h", "u"])

    return written(kinds.mapInArrow(hashed, "h long, u boolean"), "item-names")


def with_names(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, text, names, common): each text with the hashes of those of its own words that are names or common words of the items.

    For vocabularies of items too large to send out: the distinct words of the texts are joined with them by hash. Repeated rows stay.
    """

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                # the spellings that Slots.parts may look up: of the unmarked, decomposed text, folded word by word
                t = _unmarked(t or "")
                t = _drop(unicodedata.normalize("NFKD", t)) if _PLAIN.search(t) else t
                own = {f for w in _WORD.findall(t) for f in words(w)}
                own |= {x[2] for f in list(own) if (x := _ATTACHED.fullmatch(f))}
                if own:
                    h = np.array([_word_hash(w) for w in own], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.string()), pa.array(h)], names=["key", "h"])

    keyed = written(texts.withColumn("key", F.uuid()), "texts")
    word = keyed.select("key", "text").mapInArrow(own_words, "key string, h long").join(kinds, "h")
    sets = word.groupBy("key").agg(F.collect_list(F.when(F.col("u"), F.col("h"))).alias("names"), F.collect_list(F.when(~F.col("u"), F.col("h"))).alias("common"))
    return keyed.join(sets, "key", "left").select("id", "text", "names", "common")


def slot_matches(documents: DataFrame, eval_items: DataFrame, most_names: int = MAX_ITEM_WINDOWS) -> DataFrame:
    """(doc_id, item_id, doc_window, item_window): pairs of windows of equal template, names included, each distinct pair once.

    A window of the document that the item holds as it is is a copy, and not paired with other windows of that item. Up to
    ``most_names`` words of the items are sent out as hashes; beyond that they are joined (:func:`with_names`), with the same result.
    """
    spark = documents.sparkSession
    it = eval_items.select(F.col("item_id").alias("id"), "text").filter("id is not null")
    d = documents.select(F.col("doc_id").alias("id"), "text").filter("id is not null")
    kinds = _name_kinds(it)
    sets = None
    if kinds.limit(most_names + 1).count() <= most_names:
        t = kinds.toArrow()
        h, u = t.column("h").to_numpy().view(np.uint64), t.column("u").to_numpy().astype(bool)
        sets = spark.sparkContext.broadcast((np.sort(h[u]), np.sort(h[~u])))
    else:
        it, d = with_names(it, kinds), with_names(d, kinds)
    item_w = written(slot_windows(it, sets).distinct(), "item-slots")
    lengths = {r[0] for r in item_w.select("n").distinct().collect()}
    wanted = None
    hashes = item_w.select("h").distinct()
    if hashes.limit(MAX_ITEM_WINDOWS + 1).count() <= MAX_ITEM_WINDOWS:
        h = np.array([r[0] for r in hashes.collect()], dtype=np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(h))
    doc_w = slot_windows(d, sets, lengths, wanted).distinct()
    i = broadcast_if_small(item_w.select(F.col("id").alias("item_id"), "h", F.col("window").alias("item_window"), "shape"))
    pairs = doc_w.select(F.col("id").alias("doc_id"), "h", F.col("window").alias("doc_window"), "shape").join(i, ["h", "shape"])
    copies = broadcast_if_small(item_w.select(F.col("id").alias("item_id"), F.col("window").alias("doc_window")).distinct())
    return pairs.drop("h", "shape").join(copies, ["item_id", "doc_window"], "left_anti").distinct()  # a pair may occur in several readings


def reparameterised(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows): documents that carry an item's template with other numbers, names or units, slots exchanged
    consistently, and no copy of the item's own passage at that place. ``windows`` counts distinct window pairs.

    A passage is ten words of the item or more; a slot may be filled with another number of words. Names of documents are told by
    their own capitals; in a text written without capitals, or in a script that has none, only names of the items are known.
    """
    m = slot_matches(documents, eval_items)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [consistent(x, y) for x, y in zip(b.column("doc_window").to_pylist(), b.column("item_window").to_pylist())]
            yield b.select(["doc_id", "item_id"]).filter(pa.array(ok, pa.bool_()))

    c = m.mapInArrow(check, "doc_id long, item_id long")
    return c.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("windows"))
