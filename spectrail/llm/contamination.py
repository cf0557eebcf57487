"""Evaluation texts that leak into a corpus, wholly, partly or with other parameters.

Both sides are canonicalised word by word: markup, case, accents and punctuation go, and numbers, units and names become
typed placeholders. What is a name follows from use, not from form: a word that is neither a function word nor shared by
several items. Windows of the resulting templates are hash-joined; a window that would be mostly placeholders keeps its
words. Each hit is then checked for its slots. Where the filled slots agree too, the run of equal words is extended to both
sides, counting changed, added and missing words; where they differ but are replaced throughout in the same way, and the
matched windows are the item's own and not ones that items share, the item was re-parameterised.

Nothing is lost by the windows: a passage of 20 or more words with one altered word in eight holds six words in a row that
are unaltered (k alterations cut 8k words into k + 1 runs), and equal words have equal templates.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, hot_keys, salted_join
from spectrail.session import cut

#: Words in a template window, and those of them that must be no placeholders; else the window keeps its words.
WINDOW, LITERALS = 6, 3
#: A leak is a run of so many equal words, or a passage of so many with at most one in ALTERED changed, added or left out.
EXACT_WORDS, PASSAGE_WORDS, ALTERED = 12, 20, 8
#: A re-parameterised item: words that match, windows among them that no other item has (unless it alone is in question), and part of them that another item may explain better.
SAME_WORDS, OWN_WINDOWS, SHARED_PART = 16, 1, 0.5
#: A word that so many items share, at least and as a part of them all, is no name.
COMMON_ITEMS, COMMON_PART = 2, 0.005
#: Items whose windows are held in memory; more go by a shuffled join of windows.
BLOCK_ITEMS = 20_000
#: Documents that a worker holds as arrays at once, and words it remembers before it starts anew.
DOCS_AT_ONCE, REMEMBERED = 500, 1_000_000

#: Units after numbers.
UNITS = "s sec second seconds min minute minutes h hour hours day days week weeks percent mille millidalton mda da dalton daltons ppm mass units unit ml mg ug mm nm mz kv ev rpm bar psi".split()
#: Function words of English, in which the items are written.
FUNCTION_WORDS = (
    "a about above after again all an and any are as at be because been before below between both but by can could did do does down during each either every for from had has have how if in into is it its "
    "least less many may might more most must near no nor not of off on once only or other ought out over same shall should since so some such than that the their them then there these they this those though "
    "through to too under until up was were what when where whether which while who whose why will with within would you your"
).split()
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_NUMBER = re.compile(r"\d+(?:st|nd|rd|th)?")
_UNITS, _FUNCTION_WORDS = frozenset(UNITS), frozenset(FUNCTION_WORDS)
_FACTOR = 0x9E3779B97F4A7C15 | 1


def canonical_word(word: str) -> str:
    """A word by its letters and digits alone, without case, accents and compatibility forms."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return "".join(c for c in word.casefold() if c.isalnum())


def template_word(word: str, common: frozenset[str] = frozenset()) -> str:
    """The typed placeholder that stands for a canonical word, or the word itself if it is a function word or one of the common ones."""
    if _NUMBER.fullmatch(word):
        return "<number>"
    if word in _UNITS:
        return "<unit>"
    return word if word in _FUNCTION_WORDS or (word in common and word.isalpha()) else "<name>"


def common_words(counts: dict[str, int], items: int) -> frozenset[str]:
    """Words that enough of the items share. counts: items by word."""
    least = max(COMMON_ITEMS, ceil(COMMON_PART * items))
    return frozenset(w for w, n in counts.items() if n >= least)


def _bare(text: str) -> str:
    """A text without tags, its character references resolved."""
    if "<" in text:
        text = _MARKUP.sub("", text)
    return unescape(text) if "&" in text else text


class Words(dict):
    """Maps a written word to a number; arrays give the hashes of the canonical word and of its template (0: no word)."""

    def __init__(self, common: frozenset[str] = frozenset()) -> None:
        super().__init__()
        self.common = common
        self.own, self.template = [0], [0]

    def __missing__(self, word: str) -> int:
        canonical = canonical_word(word)
        if canonical:
            self[word] = len(self.own)
            self.own.append(xxhash.xxh3_64_intdigest(canonical))
            self.template.append(xxhash.xxh3_64_intdigest(template_word(canonical, self.common)))
        else:
            self[word] = 0
        return self[word]

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hashes and template hashes of all words of the texts, one after the other, and each word's text."""
        lists = [_bare(t).split() if t else [] for t in texts]
        numbers = np.concatenate([np.fromiter(map(self.__getitem__, x), np.int64, len(x)) for x in lists] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        kept = numbers > 0
        numbers, owner = numbers[kept], owner[kept]
        found = np.array(self.own, np.uint64)[numbers], np.array(self.template, np.uint64)[numbers], owner
        if len(self.own) > REMEMBERED:
            self.clear()
            self.own, self.template = [0], [0]
        return found


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of so many words."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(_FACTOR) + hashes[k : k + n]
        out ^= out >> np.uint64(31)
        return out * np.uint64(_FACTOR)


def window_keys(own: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window (of its template, or of its words if too many are placeholders) and the hash of its words."""
    exact, n = rolling(own, WINDOW), max(0, len(own) - WINDOW + 1)
    literal = np.r_[0, np.cumsum(own == template)]
    return np.where(literal[WINDOW : WINDOW + n] - literal[:n] >= LITERALS, rolling(template, WINDOW), exact), exact


class ItemIndex:
    """The template windows of items, sorted by key, behind a bit table that turns most words away."""

    def __init__(self, ids: list[int], texts: list[str | None], common: frozenset[str] | None = None, shared: np.ndarray | None = None) -> None:
        """common: words that items share, counted over these items if not given; shared: keys that several items have, if these are not all items."""
        self.ids, self.key = ids, uuid.uuid4().hex
        if common is None:
            common = common_words(Counter(w for t in texts for w in item_words(t)), len(texts))
        self.common = common
        own, template, owner = Words(common).arrays(texts)
        starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.own = [own[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
        h, exact = window_keys(own, template)
        inside = owner[: len(h)] == owner[WINDOW - 1 :][: len(h)]
        at = np.flatnonzero(inside)
        at = at[np.argsort(h[at], kind="stable")]
        self.hashes, self.item, self.place, self.exact = h[at], owner[at], at - starts[owner[at]], exact[at]
        # Whether a window is in one item alone.
        pairs = np.unique(np.stack([self.hashes, self.item.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(at) else self.hashes
        keys, times = np.unique(pairs, return_counts=True)
        self.alone = times[np.searchsorted(keys, self.hashes)] == 1 if len(at) else np.zeros(0, bool)
        if shared is not None:
            self.alone &= ~np.isin(self.hashes, shared)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, own: np.ndarray, template: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows (document, item, word of the document, word of the item, whether the slots agree, whether only this item has the window) for each pair of equal windows."""
        h, exact = window_keys(own, template)
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] & (owner[: len(h)] == owner[WINDOW - 1 :][: len(h)]))
        low, high = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
        times = high - low
        if not times.sum():
            return np.zeros((0, 6), np.int64)
        at = np.repeat(maybe, times)
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        return np.stack([owner[at], self.item[entry], at, self.place[entry], exact[at] == self.exact[entry], self.alone[entry]], axis=1)


def fewest_edits(item: list[int], text: list[int], most: int) -> list[int]:
    """For each length a: the fewest words changed, added or left out between the first a words of item and some beginning of text; most + 1 if more."""
    none = most + 1
    row = [k if k <= most else none for k in range(2 * most + 1)]  # row[k]: text position a + k - most
    row = [none] * most + list(range(most + 1))
    out = [0]
    for a, word in enumerate(item, 1):
        new = [none] * (2 * most + 1)
        for k in range(2 * most + 1):
            j = a + k - most
            if j < 0 or j > len(text):
                continue
            best = row[k + 1] + 1 if k < 2 * most else none
            if j and (x := row[k] + (text[j - 1] != word)) < best:
                best = x
            if k and (x := new[k - 1] + 1) < best:
                best = x
            new[k] = min(best, none)
        row = new
        out.append(min(row))
        if out[-1] == none:
            return out
    return out


def altered_passage(item: list[int], text: list[int], i: int, j: int, length: int) -> tuple[int, int, int]:
    """(words, begin, end) of the longest passage of item around the equal run item[i:i+length] = text[j:j+length] with one altered word in ALTERED at most, and of about where it is in text; 0 words if it is too short."""
    most = len(item) // ALTERED
    reach = len(item) + most
    before = fewest_edits(item[:i][::-1], text[max(0, j - reach) : j][::-1], most)
    after = fewest_edits(item[i + length :], text[j + length : j + length + reach], most)
    found = (0, j, j)
    for a, x in enumerate(before):
        for b, y in enumerate(after):
            n = a + length + b
            if n > found[0] and n >= PASSAGE_WORDS and (x + y) * ALTERED <= n:
                found = (n, max(0, j - a), j + length + b)
    return found


def _runs(places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs (item word, document word, words) of equal windows, from rows (document word, item word)."""
    order = np.lexsort((places[:, 1], places[:, 0] - places[:, 1]))
    d, p = (places[:, 0] - places[:, 1])[order], places[:, 1][order]
    cut = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(p) != 1)])
    for a, b in zip(cut, [*cut[1:], len(p)], strict=True):
        yield int(p[a]), int(p[a] + d[a]), int(b - a) + WINDOW - 1


def _reparameterised(part: np.ndarray, first: int, goal: list[int], text: list[int], taken: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(words, own windows, places) of the item's words that the document has with slots replaced, and where; None if they are too few.

    part: hits of one document and item; taken: words of the document that other items explain word by word. Runs are taken
    from the longest on; a run that would replace a word by two, or two by one, is left out.
    """
    free = part[~taken[part[:, 2] - first]]
    alone = {(int(p), int(d)) for _, _, d, p, _, only in free if only}
    to: dict[int, int] = {}
    back: dict[int, int] = {}
    used: dict[int, int] = {}  # words of the item by those of the document
    own = 0
    for i, j, k in sorted(_runs(free[:, 2:4]), key=lambda r: -r[2]) if len(free) else []:
        j -= first
        new = {a: b for a, b in zip(goal[i : i + k], text[j : j + k], strict=True)}
        turned = {b: a for a, b in new.items()}
        agree = all(new[a] == b and to.get(a, b) == b and back.get(b, a) == a for a, b in zip(goal[i : i + k], text[j : j + k], strict=True)) and len(turned) == len(new)
        if not agree or any(used.get(j + x, i + x) != i + x for x in range(k)):
            continue
        to |= new
        back |= turned
        used.update(zip(range(j, j + k), range(i, i + k), strict=True))
        own += sum((i + x, j + x + first) in alone for x in range(k - WINDOW + 1))
    if len(used) < SAME_WORDS or all(a == b for a, b in to.items()):
        return None
    return len(used), own, np.array(sorted(used))


def leaks_of(index: ItemIndex, words: Words, texts: list[str | None]) -> Iterator[tuple[int, int, str, int]]:
    """(document, item, kind, words) of each document and each item that it holds; kind: exact, altered or reparameterised."""
    own, template, owner = words.arrays(texts)
    hits = index.hits(own, template, owner)
    if not len(hits):
        return
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    docs = np.flatnonzero(np.r_[True, np.diff(hits[:, 0]) != 0])
    for low, high in zip(docs, [*docs[1:], len(hits)], strict=True):
        doc = int(hits[low, 0])
        first = int(starts[doc])
        text = own[first : starts[doc + 1]].tolist()
        cut = low + np.flatnonzero(np.r_[True, np.diff(hits[low:high, 1]) != 0])
        taken, rest = np.zeros(len(text), bool), []
        for a, b in zip(cut, [*cut[1:], high], strict=True):
            item, part = int(hits[a, 1]), hits[a:b]
            goal, agreeing = index.own[item], part[part[:, 4] == 1]
            runs = sorted(_runs(agreeing[:, 2:4]), key=lambda r: -r[2]) if len(agreeing) else []
            if runs and runs[0][2] >= EXACT_WORDS:
                for _, j, k in runs:
                    taken[j - first : j - first + k] = True
                yield doc, item, "exact", runs[0][2]
                continue
            passage = (0, 0, 0)
            if len(goal) >= PASSAGE_WORDS:
                passage = next((p for i, j, k in runs if (p := altered_passage(goal, text, i, j - first, k))[0]), passage)
            if passage[0]:
                taken[passage[1] : passage[2]] = True
                yield doc, item, "altered", passage[0]
            elif len(part) > SAME_WORDS // 2:
                rest.append((item, part))
        found = sorted(((*x, item) for item, part in rest if (x := _reparameterised(part, first, index.own[item], text, taken))), key=lambda x: (-x[0], x[3]))
        single = len(found) == 1 or len(found) > 1 and found[0][0] > found[1][0]
        for n, windows, places, item in found:
            sure = windows >= OWN_WINDOWS or single and not taken.any()
            if sure and taken[places].sum() <= SHARED_PART * len(places):
                taken[places] = True
                yield doc, item, "reparameterised", n


def item_words(text: str | None) -> set[str]:
    """The distinct canonical words of an item."""
    return {c for w in _bare(text).split() if (c := canonical_word(w))} if text else set()


_WORKER: dict[str, Words] = {}


def _worker_words(key: str, common: frozenset[str]) -> Words:
    """The words that this worker has met under a list of common ones."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Words(common)
    return _WORKER[key]


def shared_words(items: DataFrame) -> frozenset[str]:
    """Words that enough items share; a list whose size hangs on the length of items, not on their number."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for t in batch.column(0).to_pylist() for w in item_words(t)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["w"])

    n = items.count()
    counts = items.select("t").mapInArrow(spell, "w string").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(COMMON_ITEMS, ceil(COMMON_PART * n)))
    return common_words({r.w: r.n for r in counts.collect()}, n)


def _windows(df: DataFrame, row: str, kind: str, key: str, common: frozenset[str]) -> DataFrame:
    """(row, key): the distinct window keys of each text (columns row and t)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(key, common)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                piece = batch.slice(k, DOCS_AT_ONCE)
                own, template, owner = words.arrays(piece.column(1).to_pylist())
                h, _ = window_keys(own, template)
                inside = np.flatnonzero(owner[: len(h)] == owner[WINDOW - 1 :][: len(h)])
                pairs = np.unique(np.stack([owner[inside].astype(np.uint64), h[inside]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(pairs[:, 0].astype(np.int64))), pa.array(pairs[:, 1].view(np.int64))], names=[row, "key"])

    return df.select(row, "t").mapInArrow(scan, f"{row} {kind}, key long")


def _leaks_in_memory(docs: DataFrame, index: ItemIndex, kind: str) -> DataFrame:
    """Leaks of the items of one index: the corpus streams past it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        words = _worker_words(index.key, index.common)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                piece = batch.slice(k, DOCS_AT_ONCE)
                rows = list(leaks_of(index, words, piece.column(1).to_pylist()))
                if rows:
                    at, item, kinds, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(at)), pa.array([index.ids[x] for x in item], pa.int64()), pa.array(kinds), pa.array(n, pa.int32())],
                        names=["d", "i", "kind", "n_words"],
                    )

    return docs.mapInArrow(scan, f"d {kind}, i long, kind string, n_words int")


def _leaks_by_join(docs: DataFrame, items: DataFrame, kind: str, common: frozenset[str], hot_rows: int) -> DataFrame:
    """Leaks of any number of items: windows are joined by a shuffle, then each document is compared with the items that it shares a window with.

    A window that many documents have is salted. Only documents with a hit go on, each with the texts of its items.
    """
    key = uuid.uuid4().hex
    rows = docs.select("d", "t", F.monotonically_increasing_id().alias("r"))
    rows = cut(rows.where("t IS NOT NULL AND t <> ''"))
    own = cut(_windows(items, "i", "long", key, common))
    theirs = _windows(rows, "r", "long", key, common)
    seen = cut(theirs.join(own.select("key").distinct(), "key", "left_semi"))
    shared = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("shared"))
    hot = hot_keys(seen.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", hot_rows)
    pairs = salted_join(seen, own.join(shared, "key", "left"), ["key"], hot, F.hash("r")).groupBy("r", "i").agg(F.collect_set(F.when(F.col("shared"), F.col("key"))).alias("shared"))
    found = pairs.join(items.where("i IS NOT NULL"), "i").groupBy("r").agg(F.collect_list(F.struct("i", "t", "shared")).alias("items"))
    met = rows.join(found, "r").select("d", "t", "items")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(key, common)
        for batch in batches:
            for d, t, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.sort(key=lambda x: x["i"])
                index = ItemIndex([x["i"] for x in held], [x["t"] for x in held], common, np.array([k for x in held for k in x["shared"]], np.int64).view(np.uint64))
                got = [(d, index.ids[i], kind, n) for _, i, kind, n in leaks_of(index, words, [t])]
                if got:
                    ds, ids, kinds, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ds, batch.schema.field(0).type), pa.array(ids, pa.int64()), pa.array(kinds), pa.array(n, pa.int32())], names=["d", "i", "kind", "n_words"])

    return met.mapInArrow(check, f"d {kind}, i long, kind string, n_words int")


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block_items: int = BLOCK_ITEMS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, item_id, kind, n_words): each document and item that it contains, wholly, altered or re-parameterised.

    kind is exact for EXACT_WORDS or more equal words in a row, altered for a passage of PASSAGE_WORDS or more with at most
    one word in ALTERED changed, added or left out, and reparameterised for SAME_WORDS or more words of the item's template
    whose slots are all replaced consistently and which no other item explains better: OWN_WINDOWS of its windows are in no
    other item, or no other item matches as well and the document holds none. Words are runs of characters between white space; those without any letter or digit count for nothing.
    Null and empty texts hold nothing; texts of any length are used whole; documents with equal ids or texts each have
    their own rows. Items shorter than EXACT_WORDS can't be found. Up to block_items items are held in memory, more are
    found by a shuffled join of windows; both ways give the same rows.
    """
    kind = dict(docs.dtypes)[doc_id]
    own = cut(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")))
    common = shared_words(own)
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    held = own.limit(block_items + 1).collect()
    if len(held) <= block_items:
        held = sorted(held, key=lambda r: (r.i is None, r.i or 0, r.t or ""))
        found = _leaks_in_memory(texts, ItemIndex([r.i for r in held], [r.t for r in held], common), kind)
    else:
        found = _leaks_by_join(texts, own, kind, common, hot_rows)
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "kind", "n_words")
