"""Languages of documents and of their segments, by cross-parsing entropy.

For each language a suffix automaton is built over running text that is labelled with it. A text is parsed against each
automaton from left to right, across words, into longest matches (phrases); phrases times the logarithm of the automaton's
text size is the text's cost in the language, and the language with the least cost wins. For mixed texts the same holds of
every segment: words are cut into segments of one language, or none, so that the total cost is least; a border costs a
fixed number of phrases, and letters outside all languages cost what phrases of NONE_LETTERS letters would.

Labels may be wrong and texts may be mixed, so the labelled sample is cleaned first: a piece of it is kept only if its
letter sequences are much more widely shared by the sampled documents of its label than by those of any other one.

The automata step through many texts and all languages at once, as one array lookup a letter.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.session import cut

#: The languages told apart, with their usual codes and English names.
LANGUAGES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish", "castilian"],
    "pt": ["pt", "por", "portuguese"],
    "it": ["it", "ita", "italian"],
    "nl": ["nl", "nld", "dut", "dutch", "flemish"],
    "ru": ["ru", "rus", "russian"],
}
CODES = list(LANGUAGES)
#: The sample that the automata are built of: labelled documents per language, a window of so many characters of each (anywhere in it), letters of clean text per language.
SAMPLE_DOCS, SAMPLE_CHARS, MODEL_LETTERS = 300, 6_000, 80_000
#: Cleaning of the sample: words of a piece, letters of a sequence, times that its label must share them more widely than any other, and part of its label's usual share, rounds; words beside a border that aren't learnt from.
PIECE_WORDS, GRAM, CLEAR, USUAL, CLEANINGS, BORDER_WORDS = 8, 7, 2.0, 0.2, 2, 16
#: A document has a language if a run of so many words is in it.
RUN_WORDS = 8
#: Phrases that a border between segments costs; letters a phrase of text outside all languages; words without letters (numbers, formulas) that end a run if more of them follow one another; least confidence of a run.
CHANGE, NONE_LETTERS, GAP_WORDS, LEAST_CONFIDENCE = 4.0, 3.2, 10, 0.2
#: Words of more letters are in no language. Letters after which a long text's parse starts anew (at a word), texts that step together, documents held at once, words a worker remembers.
LONGEST_WORD, CHUNK, LANES, DOCS_AT_ONCE, REMEMBERED = 100, 1_500, 2_048, 1_500, 500_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_NO_WORD = re.compile(r"[\d\[\]{}+=@/\\#|<>]")
_PIECES = re.compile(r"[^\W\d_]+")
#: Stands for a run of words without letters.
HOLE = "0"


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the automaton of all substrings of a text, by state; state 0 is the start."""
    steps: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        current = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = current
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return steps


def written_words(text: str | None) -> list[str]:
    """Runs of characters between white space, without markup."""
    return (_MARKUP.sub("", text) if "<" in text else text).split() if text else []


@lru_cache(maxsize=200_000)
def letters_of(word: str) -> str:
    """A written word in plain lower-case letters, its parts separated by blanks; HOLE if it is a number, a formula, an ion, a name with digits or too long.

    Accents don't count, since texts often lack them.
    """
    if _NO_WORD.search(word):
        return HOLE
    plain = "".join(c for c in unicodedata.normalize("NFKD", word).lower() if unicodedata.category(c) not in ("Mn", "Cf"))
    found = " ".join(_PIECES.findall(plain))
    return found if 0 < len(found) <= LONGEST_WORD else HOLE


class Model:
    """One suffix automaton per language over running text, in the form of sparse transitions.

    texts: by language, text of plain letters and blanks. A language without text is never found.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.key = uuid.uuid4().hex
        # Letters of many languages first, so that a language's row of transitions ends early.
        common = Counter([" ", HOLE, *(c for t in texts.values() for c in set(t))])
        self.letters = sorted(common, key=lambda c: (-common[c], c))
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = [max(2, len(texts.get(code, ""))) for code in CODES]
        #: Cost of a phrase, which needs log2(text size) bits to name; relative to the largest automaton.
        self.weights = np.array([log2(s) / log2(max(sizes)) if texts.get(code) else 1e6 for code, s in zip(CODES, sizes, strict=True)], np.float32)
        number = {c: i for i, c in enumerate(self.letters)}
        for code in CODES:
            steps = suffix_automaton(texts.get(code, ""))
            n = sum(map(len, steps))
            state = np.repeat(np.arange(len(steps), dtype=np.int32), [len(s) for s in steps])
            letter = np.fromiter((number[c] for s in steps for c in s), np.int16, n)
            target = np.fromiter((t for s in steps for t in s.values()), np.int32, n)
            self.parts.append((len(steps), state, letter, target))


class Spelling(dict):
    """Maps a written word to a number, by which `spelt` has its letters as numbers; 0 is a word without letters."""

    def __init__(self, letters: list[str]) -> None:
        super().__init__()
        self.number, self.other = {c: i for i, c in enumerate(letters)}, len(letters)
        self.spelt = [self._spell(HOLE)]

    def _spell(self, letters: str) -> np.ndarray:
        return np.array([self.number.get(c, self.other) for c in letters + " "], np.uint16)

    def __missing__(self, word: str) -> int:
        letters = letters_of(word)
        if letters == HOLE:
            self[word] = 0
        else:
            self[word] = len(self.spelt)
            self.spelt.append(self._spell(letters))
        return self[word]


class Parser:
    """Parses texts against all automata of a model at once. One table holds all transitions; a row is a state, and row numbers are offsets into it."""

    def __init__(self, model: Model) -> None:
        self.model, m = model, len(CODES)
        self.last = np.zeros((m, 1), np.int64)  # the column of all letters that the language lacks
        self.dead = np.zeros((m, 1), np.int64)  # a row without a way on
        tables, base = [], 0
        for k, (states, state, letter, target) in enumerate(model.parts):
            self.last[k] = letter.max(initial=-1) + 1
            width = int(self.last[k, 0]) + 1
            table = np.full((states + 1, width), -1, np.int32)
            table[state, letter] = base + target * width
            self.dead[k] = base + states * width
            # Where there is no way on, the entry is the complement of where a new phrase with this letter leads.
            first = np.where(table[0] < 0, self.dead[k, 0], table[0])
            tables.append(np.where(table < 0, ~first[None, :], table).astype(np.int32).reshape(-1))
            base += table.size
        self.table = np.concatenate(tables)
        self.words = Spelling(model.letters)

    def phrases(self, letters: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases that start in each word, by language. Texts of the given sizes lie one after the other in letters; ends: where words end."""
        m, out = len(CODES), np.zeros((len(ends), len(CODES)), np.int32)
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        owner = np.searchsorted(begin, ends - 1, side="right") - 1
        first = np.searchsorted(owner, np.arange(len(sizes) + 1))
        order = np.argsort(-sizes, kind="stable")
        for part in np.split(order, range(LANES, len(order), LANES)):
            size, n = sizes[part], len(part)
            longest = int(size.max(initial=0))
            lane = np.repeat(np.arange(n), size)
            inside = np.arange(len(lane)) - np.repeat(np.cumsum(size) - size, size)
            grid = np.full((longest, n), len(self.model.letters), np.int64)
            grid[inside, lane] = letters[np.repeat(begin[part], size) + inside]
            row = np.repeat(self.dead, n, axis=1).astype(np.int32)
            count = np.zeros((longest + 1, m, n), np.int16)
            at, found, sign = np.empty((m, n), np.int64), np.empty((m, n), np.int32), np.empty((m, n), np.int32)
            for t in range(longest):
                np.minimum(grid[t], self.last, out=at)
                np.add(at, row, out=at)
                np.take(self.table, at, out=found, mode="clip")
                np.right_shift(found, 31, out=sign)  # -1 where a phrase starts
                np.subtract(count[t], sign, out=count[t + 1], casting="unsafe")
                np.bitwise_xor(found, sign, out=row)
            words = np.concatenate([np.arange(first[k], first[k + 1]) for k in part]) if n else np.zeros(0, np.int64)
            lane = np.repeat(np.arange(n), (first[1:] - first[:-1])[part])
            total = count[ends[words] - begin[part][lane], :, lane]
            head = np.r_[True, np.diff(lane) != 0] if len(lane) else np.zeros(0, bool)
            out[words] = np.diff(total, axis=0, prepend=np.zeros((1, m), total.dtype))
            out[words[head]] = total[head]
        return out

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per written word of the texts its cost in each language, its number of letters (0: without letters); where each text begins; phrases."""
        lists = [written_words(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words = Spelling(self.model.letters)
        counts = np.array([len(x) for x in lists], np.int64)
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(lists)), np.int64, counts.sum())
        starts = np.r_[0, np.cumsum(counts)]
        n = len(numbers)
        if not n:
            return np.zeros((0, len(CODES)), np.float32), np.zeros(0, np.int64), starts, np.zeros((0, len(CODES)), np.float32)
        spelt = self.words.spelt
        size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        buffer, offset = np.concatenate(spelt), np.r_[0, np.cumsum(size)[:-1]]
        owner = np.repeat(np.arange(len(texts)), counts)
        hole = numbers == 0
        again = np.r_[False, hole[1:] & hole[:-1] & (owner[1:] == owner[:-1])]
        long = np.where(again, 0, size[numbers])
        ends = np.cumsum(long)
        place = np.arange(ends[-1]) - np.repeat(ends - long, long)
        letters = buffer[np.repeat(offset[numbers], long) + place]
        # A text is parsed in chunks of whole words.
        before = ends - long
        chunk = (before - before[starts[:-1].clip(max=n - 1)][owner]) // CHUNK
        new = np.r_[True, (np.diff(owner) != 0) | (np.diff(chunk) != 0)]
        sizes = np.add.reduceat(long, np.flatnonzero(new))
        held = np.flatnonzero(long)  # repeated holes have no letters
        phrases = np.zeros((n, len(CODES)), np.float32)
        phrases[held] = self.phrases(letters, sizes, ends[held])
        phrases[hole] = 0
        return phrases * self.model.weights, np.where(hole, 0, long - 1), starts, phrases


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums along the last axis, beginning with 0."""
    out = np.zeros((len(values), values.shape[1] + 1))
    np.cumsum(values, axis=1, dtype=np.float64, out=out[:, 1:])
    return out


def _states(cost: np.ndarray, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The state (a language, or len(CODES) for none) of each word with which the cost of the text, borders included, is least.

    cost: a row per state, a column per word. Documents whose best state is beaten by more than a border's cost on no
    stretch need no search.
    """
    k, n = cost.shape
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = sums[:, starts[1:]] - sums[:, starts[:-1]]
    best = total.argmin(axis=0)
    states = best[owner]
    if not n:
        return states
    own = np.cumsum(cost[states, np.arange(n)], dtype=np.float64)
    # The largest gain of another state over any stretch of a document; a step down of `far` per document keeps the running minimum inside it.
    far, open_docs = 1e6 * owner, np.zeros(len(sizes), bool)
    first = np.minimum(starts[:-1], n - 1)
    for other in sums[:, 1:]:
        gain = own - other
        gain -= (np.r_[0, gain][starts[:-1]])[owner]
        low = np.minimum(np.minimum.accumulate(gain - far) + far, 0)
        open_docs |= np.maximum.reduceat(gain - low, first) > CHANGE
    open_docs = np.flatnonzero(open_docs & (sizes > 0))
    for part in np.array_split(open_docs[np.argsort(sizes[open_docs])], max(1, len(open_docs) // 64)):
        if not len(part):
            continue
        longest = int(sizes[part].max())
        grid = np.zeros((longest, len(part), k))
        for r, d in enumerate(part):
            grid[: sizes[d], r] = cost[:, starts[d] : starts[d + 1]].T
        came = np.zeros((longest, len(part), k), np.int8)
        at = grid[0].copy()
        every, line = np.arange(k), np.arange(len(part))
        for t in range(1, longest):
            cheapest = at.argmin(axis=1)
            change = at[line, cheapest][:, None] + CHANGE
            stay = at <= change
            came[t] = np.where(stay, every, cheapest[:, None])
            at = np.where(stay, at, change) + grid[t]
        state = at.argmin(axis=1)
        path = np.zeros((longest, len(part)), np.int64)
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = came[t, line, state]
        for r, d in enumerate(part):
            states[starts[d] : starts[d + 1]] = path[: sizes[d], r]
    return states


def segments_of(parser: Parser, texts: list[str | None]) -> Iterator[tuple[int, str, int, int, float]]:
    """(document, language, first word, words, confidence) of each run of RUN_WORDS or more words in one language."""
    m = len(CODES)
    cost, long, starts, _ = parser.costs(texts)
    place = np.flatnonzero(long)  # words with letters; the others only count
    if not len(place):
        return
    inner = np.searchsorted(place, starts)
    rows = np.concatenate([cost[place].T, (long[place] / NONE_LETTERS)[None, :]]).astype(np.float32)
    sums = _sums(rows)
    states = _states(rows, sums, inner)
    owner = np.repeat(np.arange(len(texts)), np.diff(inner))
    new = np.r_[True, (np.diff(owner) != 0) | (np.diff(states) != 0) | (np.diff(place) > GAP_WORDS + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    # A run begins and ends with a word that is cheaper in its language than outside all of them.
    index = np.arange(len(place))
    own = rows[states, index] < rows[m]
    after = np.minimum.accumulate(np.where(own, index, len(place))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(own, index, -1))
    low, high = after[first], before[last]
    keep = np.flatnonzero((states[first] < m) & (low < high))
    keep = keep[place[high[keep]] - place[low[keep]] + 1 >= RUN_WORDS]
    a, b, lang = low[keep], high[keep] + 1, states[first[keep]]
    total = sums[:m, b] - sums[:m, a]
    least = total[lang, np.arange(len(keep))]
    total[lang, np.arange(len(keep))] = np.inf
    sure = 1 - least / total.min(axis=0, initial=np.inf)
    sure_enough = sure >= LEAST_CONFIDENCE
    doc, at = owner[a], place[a] - starts[owner[a]]
    for s in np.flatnonzero(sure_enough):
        yield int(doc[s]), CODES[lang[s]], int(at[s]), int(place[b[s] - 1] - place[a[s]] + 1), float(sure[s])


def label_code(label: Column) -> Column:
    """The language that a label names by any usual code (with or without a region) or its English name; else null."""
    low = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    names = F.create_map(*[F.lit(x) for code, forms in LANGUAGES.items() for form in forms for x in (form, code)])
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.element_at(F.split(low, "[-_]"), 1)))


def _sequences(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each sequence of GRAM letters in the pieces, and the piece it is in."""
    text = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    piece = np.cumsum(text == 10) - (text == 10)
    value = np.zeros(max(0, len(text) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        value = value * np.uint64(0x9E3779B97F4A7C15) + text[k : k + len(value)]
    inside = piece[: len(value)] == piece[GRAM - 1 :]
    inside &= text[GRAM - 1 :] != 10
    return np.unique(value[inside], return_inverse=True)[1], piece[: len(value)][inside]


def clean_text(sample: list[tuple[str, str]], most: int = MODEL_LETTERS) -> dict[str, str]:
    """Running text per language, most letters of it at most, of labelled texts (language, text) whose labels may be wrong.

    Texts are cut into pieces of PIECE_WORDS words. A piece is clear if its letter sequences are in CLEAR times as large a
    share of the other texts of its label as of any other language's, and not much less widely shared than its label's median
    piece; it is kept if its neighbours and most pieces of its text are clear, too.
    This is done with the texts as they are labelled and again with what was kept. So text under a wrong label goes as
    long as the right label is given to it clearly more often, whatever part of a label's texts is wrong.
    """
    pieces: list[str] = []
    owner, label = [], []
    for i, (code, text) in enumerate(sample):
        words = [letters_of(w) for w in written_words(text)]
        words = [w for j, w in enumerate(words) if w != HOLE or j == 0 or words[j - 1] != HOLE]
        for k in range(0, len(words), PIECE_WORDS):
            pieces.append(" ".join(words[k : k + PIECE_WORDS]))
            owner.append(i)
            label.append(CODES.index(code))
    if not pieces:
        return {}
    of, lang = np.array(owner), np.array(label)
    gram, piece = _sequences(pieces)
    size, m, keep = int(gram.max(initial=-1)) + 1, len(CODES), np.ones(len(pieces), bool)
    for _ in range(CLEANINGS):
        there = keep[piece]
        once = np.unique(of[piece[there]] * np.int64(max(1, size)) + gram[there])  # each sequence once a text
        texts = np.array([len(np.unique(of[keep & (lang == k)])) for k in range(m)])
        language = np.array([CODES.index(code) for code, _ in sample])[once // max(1, size)]
        held = np.bincount(language * size + once % max(1, size), minlength=m * size).reshape(m, size)
        score = np.array([np.bincount(piece, held[k][gram], len(pieces)) for k in range(m)])
        n = np.bincount(piece, minlength=len(pieces))
        at = np.arange(len(pieces))
        score[lang[at], at] -= n * keep  # without the text's own sequences
        share = score / np.maximum(1, texts)[:, None]
        own = share[lang[at], at].copy()
        share[lang[at], at] = 0
        clear = (own > 0) & (own >= CLEAR * share.max(axis=0))
        usual = np.array([np.median((own / np.maximum(1, n))[clear & (lang == k)]) if (clear & (lang == k)).any() else 0.0 for k in range(m)])
        clear &= own >= USUAL * usual[lang] * n
        votes = np.bincount(of, np.where(clear, 1, -1), len(sample))
        apart = np.r_[True, np.diff(of) != 0, True]
        keep = clear & (votes[of] > 0) & (np.r_[True, clear[:-1]] | apart[:-1]) & (np.r_[clear[1:], True] | apart[1:])
    return _joined(((CODES[lang[k]], pieces[k]) for k in np.flatnonzero(keep)), most)


def _joined(parts: Iterator[tuple[str, str]], most: int) -> dict[str, str]:
    """The texts (language, letters) joined by language, in their order, up to most letters each."""
    found: dict[str, list[str]] = {}
    used = Counter()
    for code, letters in parts:
        if used[code] < most:
            found.setdefault(code, []).append(letters[: most - used[code]])
            used[code] += len(letters) + 1
    return {code: " " + " ".join(texts) + " " for code, texts in found.items()}


def model_of(sample: list[tuple[str, str]], most: int = MODEL_LETTERS) -> Model:
    """A model of labelled texts whose labels may be wrong: of the clean text first, then of what lies well within the segments that this model finds in the language of their label."""
    parser = Parser(Model(clean_text(sample, most)))
    main: dict[int, Counter] = {}
    found = []
    for k in range(0, len(sample), 300):
        found += [(k + doc, *rest) for doc, *rest in segments_of(parser, [t for _, t in sample[k : k + 300]])]
    del parser
    for doc, code, _, n, _ in found:
        main.setdefault(doc, Counter())[code] += n
    inner = []
    for doc, code, first, n, _ in found:
        if code == sample[doc][0] == main[doc].most_common(1)[0][0]:
            words = written_words(sample[doc][1])
            low, high = first + (BORDER_WORDS if first else 0), first + n - (BORDER_WORDS if first + n < len(words) else 0)
            if low < high:
                inner.append((code, " ".join(map(letters_of, words[low:high]))))
    return Model(_joined(iter(inner), most))


def fit(docs: DataFrame, doc_id: str, text: str, label: str, sample_docs: int = SAMPLE_DOCS, draw: int = 0) -> Model:
    """A model of the labelled documents: sample_docs per language at most, picked by a hash of their ids, and of each a window of SAMPLE_CHARS at a place the hash gives.

    draw: another number gives another sample.
    """
    labelled = docs.select(F.col(doc_id).alias("d"), label_code(F.col(label)).alias("code"), F.length(text).alias("n")).where("code IS NOT NULL AND n > 0")
    best = Window.partitionBy("code").orderBy(F.xxhash64("d", F.lit(draw)), "d")
    picked = cut(labelled.withColumn("k", F.row_number().over(best)).where(F.col("k") <= sample_docs).select("d", "code", "n", "k"))
    begin = 1 + F.pmod(F.xxhash64("d", F.lit(draw), F.lit(1)), F.greatest(F.col("n") - SAMPLE_CHARS, F.lit(1)))
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(picked), "d").select("code", "k", F.col("t").substr(begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("t")).collect()
    return model_of([(r.code, r.t) for r in sorted(rows, key=lambda r: (r.code, r.k, r.t))])


_WORKER: dict[str, Parser] = {}


def _worker_parser(shared: Broadcast) -> Parser:
    """This worker's parser of the model that it was sent, kept from task to task."""
    model = shared.value
    if model.key not in _WORKER:
        _WORKER.clear()
        _WORKER[model.key] = Parser(model)
    return _WORKER[model.key]


def find_segments(docs: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """(doc_id, lang, first_word, n_words, confidence): every segment of RUN_WORDS or more words in one language.

    Words are runs of characters between white space. Numbers, formulas and names count within a segment but don't make
    one; null and empty texts, and texts without any such run, have no segment. Texts of any length are used whole.
    confidence is the part of its cost in the next best language that the segment saves. The model has a fixed bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _worker_parser(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                piece = batch.slice(k, DOCS_AT_ONCE)
                found = list(segments_of(parser, piece.column(1).to_pylist()))
                if found:
                    at, lang, first, n, sure = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(at)), pa.array(lang), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(sure)],
                        names=["d", "lang", "first_word", "n_words", "confidence"],
                    )

    found = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(scan, f"d {dict(docs.dtypes)[doc_id]}, lang string, first_word int, n_words int, confidence double")
    return found.withColumnRenamed("d", doc_id)


def cross_parse(docs: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """(doc_id, n_letters, phrases_en ... phrases_ru, lang, confidence): each document parsed whole against every language.

    lang needs the fewest normalised phrases; confidence is the part of the next best language's phrases that it saves. Null
    and empty texts, texts without letters and ties have no language (null) and confidence 0. One row per row of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"phrases_{code}" for code in CODES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _worker_parser(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                piece = batch.slice(k, DOCS_AT_ONCE)
                cost, long, starts, phrases = parser.costs(piece.column(1).to_pylist())
                sums = [np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)]) for x in (cost, phrases, long[:, None])]
                total, count, letters = (s[starts[1:]] - s[starts[:-1]] for s in sums)
                order = np.sort(total, axis=1)
                sure = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9)
                sure[letters[:, 0] == 0] = 0
                lang = [CODES[k] if s > 0 else None for k, s in zip(total.argmin(axis=1), sure, strict=True)]
                columns = [piece.column(0), pa.array(letters[:, 0].astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in count.T), pa.array(lang, pa.string()), pa.array(np.maximum(sure, 0))]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "n_letters", *names, "lang", "confidence"])

    schema = f"d {dict(docs.dtypes)[doc_id]}, n_letters long, {', '.join(f'{n} long' for n in names)}, lang string, confidence double"
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(scan, schema).withColumnRenamed("d", doc_id)
