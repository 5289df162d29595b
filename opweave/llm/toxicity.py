"""Abusive, hateful or sexual content, told by compression distance.

Two zstandard dictionaries are trained apart, one on ordinary text and one on toxic text of rated
documents.  A window of a document that compresses to fewer bytes with the toxic dictionary than with
the ordinary one says what toxic text says; the largest difference of its windows is a document's score.

Words are compressed as eight-byte codes, not as letters: a word that a dictionary doesn't know costs its
eight bytes in either, however it is spelt, and what both know costs the same in both.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Folding

#: At most so many rated documents are fitted on: those with the least hash of their id.
MAX_RATED = 12_000
#: Words in a window.
WINDOWS = (1, 2, 3)
#: Size of the trained part of the ordinary dictionary; the trainer fills it with what ordinary documents share most.
ORDINARY_BYTES = 400_000
LEVEL = 3
#: The share of phrases chosen as toxic text that may be there by chance, for each length of phrase.
FALSE_PHRASES = 0.01
#: A phrase is also ordinary text if so few of its documents were rated toxic with less than this chance, were it only toxic.
TWO_SIDED = 0.05
#: Phrases are looked up in the corpus if rated toxic documents have them so many times as often as ordinary ones.
RATED_LIFT = 4
#: A word in fewer ordinary than a tenth of its toxic documents is there by wrong ratings.
WRONG = 0.1
#: Thresholds to choose from: smaller differences come from the rounding of bits to bytes.
THRESHOLDS = range(3, 24)
#: What a phrase of two words gains that only toxic text has; of thresholds about equally good the nearest is taken.
USUAL_GAIN = 7

# Signs written for letters, and letters of two scripts that look alike.
_LEET = str.maketrans("013457@$€", "oieastase")
_CYRILLIC, _LATIN = "аеорсухкмтвні", "aeopcyxkmtbhi"

_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYRILLIC, _LATIN), str.maketrans(_LATIN, _CYRILLIC)
_FOLDING = Folding(kept="*@$€")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
_MASKED = re.compile(r"[^\W\d_]\*\*")
_DIGITS = re.compile(r"\d+")
_TWICE = re.compile(r"([^\W\d_])\1+")
_CYRILLIC_LETTER, _LATIN_LETTER = re.compile("[Ѐ-ӿ]"), re.compile("[a-z]")
_KEPT_WORDS = 400_000


class _Spelling(dict):
    """Words with the usual disguises undone, kept for words met again."""

    def __missing__(self, w: str) -> str:
        v = w
        if not v.isalpha():
            if v[0] == "*":
                v = v.strip("*")
            if _MASKED.search(v):
                v = "mskd"
            else:
                if any(map(str.isalpha, v)):
                    v = v.translate(_LEET)
                v = _DIGITS.sub("0", "".join(filter(str.isalnum, v)))
        if not v.isascii() and _CYRILLIC_LETTER.search(v) and (latin := len(_LATIN_LETTER.findall(v))):
            v = v.translate(_TO_LATIN if 2 * latin >= len(v) else _TO_CYRILLIC)
        v = _TWICE.sub(r"\1", v)
        if len(self) < _KEPT_WORDS:
            self[w] = v
        return v


_SPELLING = _Spelling()


def plain(text: str | None) -> list[str]:
    """A text as lower-case words of plain letters, with the usual disguises of words undone.

    Accents and invisible characters go; spaced letters are joined; digits and signs inside words
    become letters; words in two scripts become one; repeated letters single; words masked with
    asterisks one token; numbers 0.
    """
    if not text:
        return []
    t = text.translate(_FOLDING)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    return [v for w in t.split() if (v := _SPELLING[w])]


Sides = tuple[list[str], list[str]]
Phrase = tuple[str, ...]


def sides(text: str | None, first_chars: int | None) -> Sides:
    """The words of both sides of a document; without ``first_chars`` the whole text is the first."""
    if not text:
        return [], []
    if first_chars is None or first_chars != first_chars:
        return plain(text), []
    n = max(0, int(first_chars))
    return plain(text[:n]), plain(text[n:])


def phrases(words: list[str], longest: int = 3) -> Iterator[tuple[int, Phrase]]:
    """(place, phrase) of all phrases of one to ``longest`` words."""
    for n in range(1, longest + 1):
        for k in range(len(words) - n + 1):
            yield k, tuple(words[k : k + n])


def _documents_with(docs: Iterable[Sides]) -> Counter[Phrase]:
    """In how many documents each phrase occurs."""
    n: Counter[Phrase] = Counter()
    for doc in docs:
        n.update({g for side in doc for _, g in phrases(side)})
    return n


class Lookup:
    """Finds wanted phrases of up to three words in a text, touching longer ones only after their first words."""

    def __init__(self, wanted: Iterable[Phrase]):
        by_length: dict[int, set[Phrase]] = {1: set(), 2: set(), 3: set()}
        for g in wanted:
            by_length[len(g)].add(g)
        self.one = {g[0] for g in by_length[1]}
        self.two, self.three = by_length[2], by_length[3]
        self.pairs = self.two | {g[:2] for g in self.three}
        self.first = self.one | {g[0] for g in self.pairs}

    def find(self, words: list[str]) -> set[Phrase]:
        out: set[Phrase] = set()
        for k, w in enumerate(words):
            if w not in self.first:
                continue
            if w in self.one:
                out.add((w,))
            pair = tuple(words[k : k + 2])
            if pair in self.pairs:
                if pair in self.two:
                    out.add(pair)
                triple = tuple(words[k : k + 3])
                if triple in self.three:
                    out.add(triple)
        return out


Rated = list[tuple[int, bool, Sides]]


@dataclass
class Ratings:
    """What rated documents hold: in how many toxic and ordinary ones each phrase of several toxic documents is."""

    rated: Rated
    toxic: Counter[Phrase] = field(init=False)
    ordinary: Counter[Phrase] = field(init=False)
    kinds: dict[int, int] = field(init=False)
    n_toxic: int = field(init=False)
    n_ordinary: int = field(init=False)

    def __post_init__(self):
        seen = _documents_with(s for _, t, s in self.rated if t)
        self.kinds = Counter(map(len, seen))
        self.toxic = Counter({g: n for g, n in seen.items() if n >= 2})
        look = Lookup(self.toxic)
        self.ordinary = Counter()
        for _, t, doc in self.rated:
            if not t:
                self.ordinary.update(look.find(doc[0]) | look.find(doc[1]))
        self.n_toxic = sum(t for _, t, _ in self.rated)
        self.n_ordinary = len(self.rated) - self.n_toxic

    def wanted(self) -> set[Phrase]:
        """Phrases that may be toxic text by the ratings alone: what is to be counted in the corpus."""
        few = RATED_LIFT * self.n_toxic / max(1, self.n_ordinary)
        return {g for g, n in self.toxic.items() if n > few * self.ordinary[g]}


def _log_chance(k: int, n: int, rate: float) -> float:
    """Bound (Chernoff) on the logarithm of the chance of a share as far from ``rate`` as ``k`` of ``n``, on that side."""
    a, rate = min(1.0, k / n), min(max(rate, 1e-12), 1 - 1e-12)
    part = lambda x, y: x * math.log(x / y) if x > 0 else 0.0
    return -n * (part(a, rate) + part(1 - a, 1 - rate))


@dataclass
class Telling:
    """Phrases that only toxic text holds, those that both hold, and how many toxic documents the corpus has by estimate."""

    toxic: set[Phrase]
    mixed: set[Phrase]
    n_toxic: float


def telling(r: Ratings, df: dict[Phrase, int], n_docs: int) -> Telling:
    """Chosen by two tests against the corpus (``df``: in how many of all ``n_docs`` documents a phrase occurs).

    A phrase is telling if more of its documents were rated toxic than chance lets expect (of each
    length so many phrases that ``FALSE_PHRASES`` of them may be there by chance).  Documents of purely
    toxic phrases were rated with one frequency, the median of all telling ones (weighted by ratings); those significantly
    below it have harmless uses too.  The same frequency tells how many toxic documents there are.
    """
    base = r.n_toxic / max(1, n_docs)
    n_in = lambda g: max(df.get(g, 0), r.toxic[g])
    above: set[Phrase] = set()
    for length, kinds in r.kinds.items():
        tested = sorted((_log_chance(r.toxic[g], n_in(g), base), g) for g in df if len(g) == length and r.toxic[g] > base * n_in(g))
        last = max((i for i, (p, _) in enumerate(tested, 1) if p <= math.log(FALSE_PHRASES * i / kinds)), default=0)
        above |= {g for _, g in tested[:last]}
    if not above:
        return Telling(set(), set(), r.n_toxic)
    shares = sorted((r.toxic[g] / n_in(g), r.toxic[g]) for g in above)
    half, usual = sum(n for _, n in shares) / 2, 1.0
    for share, n in shares:
        half -= n
        if half <= 0:
            usual = share
            break
    low = lambda g: r.toxic[g] < usual * n_in(g) and _log_chance(r.toxic[g], n_in(g), usual) < math.log(TWO_SIDED)
    mixed = {g for g in above if low(g)}
    return Telling(above - mixed, mixed, r.n_toxic / usual)


def runs(side: list[str], wanted: set[Phrase]) -> Iterator[Phrase]:
    """The stretches of a side that wanted phrases cover."""
    covered = bytearray(len(side))
    for k, g in phrases(side):
        if g in wanted:
            covered[k : k + len(g)] = b"\1" * len(g)
    k = 0
    while k < len(side):
        end = k
        while end < len(side) and covered[end]:
            end += 1
        if end > k:
            yield tuple(side[k:end])
        k = end + 1


class _Codes(dict):
    def __missing__(self, w: str) -> bytes:
        import xxhash

        code = xxhash.xxh3_64_digest(w)
        if len(self) < _KEPT_WORDS:
            self[w] = code
        return code


_CODES = _Codes()
#: A word that no dictionary knows, and what follows every window (the compressor doesn't look for matches in the last bytes).
_STRANGE, _END = b"\xf1\x0e\x97\x5c\xa3\x28\xd4\x6b", bytes(10)


def coded(words: Iterable[str]) -> bytes:
    return b"".join(map(_CODES.__getitem__, words))


def _trained(samples: list[bytes], size: int, needed: Iterable[bytes]) -> bytes:
    """A dictionary trained on samples, followed by those needed texts that training left out."""
    import zstandard

    samples = [s for s in samples if s]
    while len(samples) < 64 or sum(map(len, samples)) < 4096:
        samples = samples + samples  # the trainer refuses to work on less
    out = zstandard.train_dictionary(max(1024, size), samples, k=64, d=8, level=3).as_bytes()
    missing, seen = [], set()
    for text in needed:
        if text not in seen and text not in out:
            seen.add(text)
            missing.append(text)
    return out + b"".join(missing)


@dataclass
class Model:
    """Both dictionaries, the words they know, and the gain in bytes from which a document counts as toxic (None: nothing to learn from)."""

    ordinary: bytes
    toxic: bytes
    toxic_words: frozenset[str]
    toxic_only: frozenset[str]
    toxic_pairs: frozenset[Phrase]
    known_words: frozenset[str]
    threshold: int | None = None

    def __post_init__(self):
        self._both, self._gains = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_both": None, "_gains": {}}

    def _compressors(self):
        if self._both is None:
            import zstandard

            self._both = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
                d.precompute_compress(level=LEVEL)
                flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
                self._both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **flags).compress)
        return self._both

    def _window_gain(self, window: tuple[str | None, ...]) -> int:
        pairs = zip(window, window[1:])
        if self.toxic_only.isdisjoint(window) and self.toxic_pairs.isdisjoint(pairs):
            return 0
        ordinary, toxic = self._compressors()
        b = b"".join(_CODES[w] if w is not None else _STRANGE for w in window) + _END
        gain = len(ordinary(b)) - len(toxic(b))
        if len(self._gains) < _KEPT_WORDS:
            self._gains[window] = gain
        return gain

    def gain(self, doc: Iterable[list[str]]) -> int:
        """The most bytes by which a window of the sides is shorter with the toxic dictionary; 0 if none is.

        Windows that can't tell anything are left out, as differences there are noise of the literals: both
        end words must be in the toxic dictionary, and one word be in that alone or two neighbours be
        in toxic text.  Words that neither dictionary knows are all alike.
        """
        best, gains, hot, known = 0, self._gains, self.toxic_words, self.known_words
        for side in doc:
            if hot.isdisjoint(side):
                continue
            size = len(side)
            for k, w in enumerate(side):
                if w not in hot:
                    continue
                for n in WINDOWS:
                    if k + n > size or side[k + n - 1] not in hot:
                        continue
                    window = tuple(side[k : k + n])
                    if n > 2:
                        window = tuple([v if v in known else None for v in window])
                    g = gains.get(window)
                    if g is None:
                        g = self._window_gain(window)
                    if g > best:
                        best = g
        return best


def dictionaries(r: Ratings, t: Telling) -> Model:
    """A model without threshold from rated documents and the phrases that tell.

    Toxic text is what telling phrases cover in toxic documents.  Ordinary text is what several ordinary
    documents share, without words that only wrong ratings brought there; the surroundings of words
    of toxic text are repeated, and phrases found in both kinds of text are added, so that harmless
    uses are known.  Training keeps what is frequent; needed texts that it left out follow.
    """
    covered: Counter[Phrase] = Counter()
    for _, toxic, doc in r.rated:
        if toxic:
            for side in doc:
                covered.update(runs(side, t.toxic))
    hot = frozenset(w for run in covered for w in run)
    shared: Counter[str] = Counter()
    for _, toxic, doc in r.rated:
        if not toxic:
            shared.update(set(doc[0]) | set(doc[1]))
    known = {w for w, n in shared.items() if n >= 2 and ((w,) not in t.toxic or n > WRONG * r.toxic[(w,)])}
    parts: list[bytes] = []
    around: list[Phrase] = []
    for _, toxic, doc in r.rated:
        if toxic:
            continue
        for side in doc:
            k = 0
            while k < len(side):
                end = k
                while end < len(side) and side[end] in known:
                    end += 1
                for at in range(k, end):
                    if side[at] in hot:
                        around.append(tuple(side[max(k, at - 2) : min(end, at + 3)]))
                if end > k:
                    parts.append(coded(side[k:end]))
                k = end + 1
    mixed = sorted(t.mixed)
    samples = parts + [coded(g) for g in around for _ in range(4)] + [coded(g) for g in mixed for _ in range(16)]
    samples.sort()
    random.Random(7).shuffle(samples)
    alone = sorted(hot & known)
    ordinary = _trained(samples or [_STRANGE], ORDINARY_BYTES, [*map(coded, mixed), *(coded((w,)) for w in alone)])
    most_last = sorted(covered, key=lambda g: (covered[g], g))
    toxic_size = sum(8 * len(g) for g in covered)
    toxic = _trained([coded(g) for g in most_last for _ in range(covered[g])] or [_END], toxic_size, map(coded, most_last))
    pairs = frozenset(p for run in covered for p in zip(run, run[1:]))
    usual = known | {w for g in mixed for w in g}
    return Model(ordinary, toxic, hot, hot - usual, pairs, hot | usual)


def calibrated(part: Model, held: Rated, n_toxic: float, n_docs: int) -> int:
    """The threshold with the best F1 over the corpus, told from held-out documents.

    The corpus is taken to have ``n_toxic`` toxic documents (:func:`telling` estimates them from the
    ratings).  Among documents rated ordinary some are toxic by wrong ratings; their share is the least
    ratio of ordinary to toxic documents found at any threshold, and is taken off the false alarms.
    """
    yes = [part.gain(s) for _, t, s in held if t]
    no = [part.gain(s) for _, t, s in held if not t]
    found = {g: sum(x >= g for x in yes) / max(1, len(yes)) for g in THRESHOLDS}
    alarms = {g: (sum(x >= g for x in no) + 0.5) / (len(no) + 1) for g in THRESHOLDS}
    wrong = min((alarms[g] / found[g] for g in THRESHOLDS if found[g] >= 0.3), default=0.0)

    def merit(g: int) -> float:
        hit = found[g] * n_toxic
        false = max(0.0, alarms[g] - wrong * found[g]) * max(0.0, n_docs - n_toxic)
        return 2 * hit / (hit + false + n_toxic) if hit else 0.0

    best = max(map(merit, THRESHOLDS))
    return min((g for g in THRESHOLDS if merit(g) >= 0.995 * best), key=lambda g: (abs(g - USUAL_GAIN), g))


def fit(r: Ratings, df: dict[Phrase, int], n_docs: int) -> Model:
    """A model from ratings, and in how many of the ``n_docs`` documents the wanted phrases are.

    The threshold is set on three tenths of the documents with dictionaries from the others; then the
    dictionaries are made from all.  All rules are the same however many documents are rated.
    """
    if not r.n_toxic or not r.n_ordinary:
        return Model(b"", b"", frozenset(), frozenset(), frozenset(), frozenset())
    apart = lambda i: random.Random(i).random() < 0.3
    t = telling(r, df, n_docs)
    model = dictionaries(r, t)
    rest = Ratings([x for x in r.rated if not apart(x[0])])
    if rest.n_toxic and rest.n_ordinary:
        known = rest.wanted()
        part = dictionaries(rest, telling(rest, {g: n for g, n in df.items() if g in known}, n_docs))
        model.threshold = calibrated(part, [x for x in r.rated if apart(x[0])], t.n_toxic, n_docs)
    else:
        model.threshold = USUAL_GAIN
    return model


def phrase_counts(documents: DataFrame, wanted: set[Phrase]) -> DataFrame:
    """``gram``, ``n``: in how many documents each wanted phrase occurs, over the whole of all documents; the empty phrase is in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, n = Lookup(wanted), Counter()
        for b in batches:
            for text, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one, two = sides(text, first)
                n.update(look.find(one) | look.find(two))
            n[()] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(g) for g in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    parts = documents.select("text", "src_chars").mapInArrow(count, "gram string, n bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def majority(ratings: DataFrame) -> DataFrame:
    """``doc_id``, ``toxic``: what more raters say of a document; documents with as many for as against are left out.

    A null category is no rating.
    """
    bad = F.count_if(F.col("category") != "none")
    good = F.count_if(F.col("category") == "none")
    votes = ratings.where(F.col("category").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"), good.alias("good"))
    return votes.where(F.col("bad") != F.col("good")).select("doc_id", (F.col("bad") > F.col("good")).alias("toxic"))


def train(documents: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """A model from the rated documents, of which at most ``max_rated`` are used.

    What is collected is bounded by that sample; the phrases in it are counted in all documents.
    """
    chosen = majority(ratings).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    rows = documents.select("doc_id", "text", "src_chars").join(chosen, "doc_id").collect()
    r = Ratings(sorted((row.doc_id, row.toxic, sides(row.text, row.src_chars)) for row in rows))
    df = {tuple(row.gram.split()): row.n for row in phrase_counts(documents, r.wanted()).collect()}
    n_docs = df.pop((), 0)
    return fit(r, df, n_docs)


def score(documents: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """``doc_id`` (or the column ``keep``), ``score``, ``toxic`` for every document, over all windows of both sides.

    ``score`` is the largest gain of a window in bytes.  Null and empty texts score 0 and aren't toxic;
    neither is anything if no ratings of both kinds were there to learn from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            gains = [model.gain(sides(t, n)) if model.threshold is not None else 0 for t, n in texts]
            toxic = [model.threshold is not None and g >= model.threshold for g in gains]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gains, pa.int32()), pa.array(toxic, pa.bool_())], names=[keep, "score", "toxic"])

    kind = documents.select(keep).schema[0].dataType.simpleString()
    return documents.select(keep, "text", "src_chars").mapInArrow(run, f"{keep} {kind}, score int, toxic boolean")


def rates(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """``source``, ``n_docs``, ``n_toxic``, ``rate``; a null source is one of its own."""
    return source_rates(documents.select("doc_id", "source").join(scores.select("doc_id", "toxic"), "doc_id"))


def source_rates(scored: DataFrame) -> DataFrame:
    """The same from ``source`` and ``toxic`` of every document: null and repeated ids count as they come."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("toxic").alias("n_toxic"),
        (F.count_if("toxic") / F.count(F.lit(1))).alias("rate"),
    )
