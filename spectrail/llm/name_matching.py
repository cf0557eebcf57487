"""Mapping of free-entered values to a canonical list.

A multi-pattern automaton over the canonical names and their aliases (words turned round, run together, the first one
abbreviated where that is unambiguous) finds mentions embedded in a value; the longest mentions that don't overlap win.
Values without one go to a token-set similarity: the words of an entry must have similar words in the value, in any
order; words that the value has besides count for nothing. Candidates come by their rarest words, and similar words by a
comparison of letter counts, which no edit within the limit can hide. Distinct values are looked at once; a long list goes
in blocks of BLOCK_ENTRIES entries, of which the best finding of a value is kept.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrail.operators.skew import HOT_ROWS, hot_keys, salted_join
from spectrail.session import bounded, cut

#: Words between or beside the parts of a species' name that are none of it.
QUALIFIERS = frozenset("cf aff x sp spp species indet subsp ssp var ex nr".split())
#: Digits that stand for letters in misread words.
MISREAD = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b"})
#: Letters of a word that may be wrong, as a part of its length and at most; a word shorter than SHORT must agree.
WRONG_PART, WRONG_MOST, SHORT = 0.25, 3, 5
#: Part of an entry's letters that a value may lack, in whole words, if the entry has three words or more.
LACKING = 0.2
#: Entries whose automaton and words a worker holds at once, and words whose findings it remembers.
BLOCK_ENTRIES, REMEMBERED = 20_000, 100_000
#: Distinct values that one task matches: matching costs far more than its few bytes suggest.
VALUES_A_TASK = 20_000
_BRACKETS = re.compile(r"\([^)]*\)|\[[^]]*\]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tokens(value: str, qualifiers: frozenset[str] = QUALIFIERS) -> list[str]:
    """The words of a name in plain lower-case letters, without qualifiers."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", _CAMEL.sub(" ", value)) if not unicodedata.combining(c)).casefold()
    words = re.findall(r"[^\W_]+", plain)
    words = [w.translate(MISREAD) if any(c.isalpha() for c in w) else w for w in words]
    return [w for w in words if w not in qualifiers and not w.isdigit()]


def edits(a: str, b: str, most: int) -> int:
    """Letters changed, added, left out or swapped with their neighbour between a and b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            n = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            new.append(n)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def allowed(word: str) -> int:
    """Letters that may be wrong in a word of the list."""
    return 0 if len(word) < SHORT else max(1, min(WRONG_MOST, int(len(word) * WRONG_PART)))


def _letter_counts(word: str) -> np.ndarray:
    """How often each of 32 classes of letters occurs: any edit changes at most one letter out and one in, a swap none."""
    return np.bincount([ord(c) & 31 for c in word], minlength=32).astype(np.int16)


class SimilarWords:
    """Finds the words of a list within the allowed number of edits of a given one; no such word is missed."""

    def __init__(self, words: set[str]) -> None:
        self.words = sorted(words)
        self.exact = set(words)
        self.most = np.array([allowed(w) for w in self.words], np.int16)
        self.counts = np.array([_letter_counts(w) for w in self.words], np.int16).reshape(-1, 32)
        self.known: dict[str, dict[str, int]] = {}

    def of(self, word: str) -> dict[str, int]:
        """Similar words with their number of edits."""
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            # Letters that are missing, and letters too many, are each no more than the edits.
            apart = self.counts - _letter_counts(word)
            over = np.maximum(apart, 0).sum(axis=1, dtype=np.int16)
            under = over - apart.sum(axis=1, dtype=np.int16)
            near = np.flatnonzero(np.maximum(over, under) <= self.most)
            self.known[word] = {w: n for w in map(self.words.__getitem__, near) if (n := edits(word, w, allowed(w))) <= allowed(w)}
        return self.known[word]


def aliases_of(words: list[str]) -> dict[str, str]:
    """The forms in which a name of these words may be mentioned, with their kind."""
    if not words:
        return {}
    forms = {" ".join(words): "full"}
    if len(words) > 1:
        for form in (" ".join(words[::-1]), " ".join([*words[1:], words[0]]), "".join(words)):
            forms.setdefault(form, "other")
        forms.setdefault(" ".join([words[0][0], *words[1:]]), "short")
    return forms


class Matcher:
    """A block of the list: its automaton and its similar words.

    entries: (ref, words, whether its abbreviated form names it alone); mentions: (form, ref) that name one entry each.
    """

    def __init__(self, entries: list[tuple[int, tuple[str, ...], bool]], mentions: list[tuple[str, int]]) -> None:
        self.key = uuid.uuid4().hex
        self.entries = sorted(set(entries))
        self.mentions = sorted(set(mentions))

    def build(self) -> Matcher:
        """Makes the automaton and the indexes; a worker does so once for each block that it is sent."""
        self.automaton = ahocorasick.Automaton()
        for form, ref in self.mentions:
            self.automaton.add_word(f" {form} ", (len(form), ref))
        if self.mentions:
            self.automaton.make_automaton()
        counts = Counter(w for _, words, _ in self.entries for w in set(words))
        self.similar_words = SimilarWords(set(counts))
        self.joined = SimilarWords({"".join(words) for _, words, _ in self.entries if len(words) > 1})
        self.whole: dict[str, int] = {}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.by_second: dict[str, list[int]] = defaultdict(list)
        for k, (ref, words, short) in enumerate(self.entries):
            if len(words) > 1:
                self.whole.setdefault("".join(words), ref)
                if short:
                    self.by_second[words[1]].append(k)
            # A value may lack a word of a long entry, so that has two ways in.
            for w in sorted(set(words), key=lambda w: (counts[w], -len(w), w))[: 1 if len(words) < 3 else 2]:
                self.by_word[w].append(k)
        return self

    def mention(self, words: list[str]) -> tuple[int, int, int] | None:
        """(letters, place, entry) of the longest mention among those that don't overlap (the first of equally long ones)."""
        if not words or not self.mentions:
            return None
        found = min(((-n, end - n, ref) for end, (n, ref) in self.automaton.iter(f" {' '.join(words)} ")), default=None)
        return found and (-found[0], found[1], found[2])

    def _apart(self, entry: int, near: list[dict[str, int]], words: list[str]) -> float | None:
        """How far the entry is from a value: the mean part of wrong letters of its words, each with a word of the value of its own; None if too many are missing."""
        _, own, short = self.entries[entry]
        free = set(range(len(words)))
        apart, lacking = 0.0, 0
        for position, w in enumerate(own):
            best = min(((near[i][w] / len(w), i) for i in free if w in near[i]), default=None)
            if best is None and position == 0 and short and len(own) > 1:
                # The first word may be an initial right before the second one.
                best = min(((0.2, i) for i in free if words[i] == w[0] and i + 1 < len(words) and own[1] in near[i + 1]), default=None)
            if best is None:
                lacking += len(w)
                apart += 1.0
            else:
                free.discard(best[1])
                apart += best[0]
        if lacking and (len(own) < 3 or lacking > LACKING * sum(map(len, own))):
            return None
        return apart / len(own)

    def similar(self, words: list[str]) -> tuple[float, int] | None:
        """(distance, entry) of the entry with the highest token-set similarity."""
        near = [self.similar_words.of(w) for w in words]
        best = [(n / len(whole), self.whole[whole]) for w in words for whole, n in self.joined.of(w).items()]
        for entry in {k for found in near for w in found for k in self.by_word.get(w, ())}:
            if (apart := self._apart(entry, near, words)) is not None:
                best.append((apart, self.entries[entry][0]))
        if not best and any(len(w) == 1 for w in words):
            # Only the abbreviated word is rare: come by the next one.
            for entry in {k for found in near for w in found for k in self.by_second.get(w, ())}:
                if (apart := self._apart(entry, near, words)) is not None:
                    best.append((apart, self.entries[entry][0]))
        return min(best, default=None)

    def match(self, value: str | None, qualifiers: frozenset[str] = QUALIFIERS) -> tuple[int, str, float, float]:
        """(entry or -1, way, similarity, order) of a value; of findings in several blocks the one with the lowest order is right."""
        if value:
            whole, bare = tokens(value, qualifiers), tokens(_BRACKETS.sub(" ", value), qualifiers)
            for k, words in enumerate((whole, bare)):
                if found := self.mention(words):
                    # The longest first, then the first in the value: a mention has fewer than 10^6 letters and places.
                    return found[2], "mention", 1.0, k * 1e13 + (1e6 - min(found[0], 999_999)) * 1e6 + min(found[1], 999_999)
            for k, words in enumerate((bare, whole)):
                if found := self.similar(words):
                    return found[1], "similar", 1 - found[0], 1e14 + k * 1e13 + found[0]
        return -1, "none", 0.0, 1e15


_WORKER: dict[str, Matcher] = {}


def _worker_matcher(shared: Broadcast) -> Matcher:
    """This worker's matcher of the block that it was sent."""
    block = shared.value
    if block.key not in _WORKER:
        _WORKER.clear()
        _WORKER[block.key] = block.build()
    return _WORKER[block.key]


def _forms(entries: DataFrame, qualifiers: frozenset[str]) -> DataFrame:
    """(ref, words, form, kind) of each name of the list."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ref, words, form, kind) for ref, name in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (words := tokens(name, qualifiers)) for form, kind in aliases_of(words).items()]
            ref, words, form, kind = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ref, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(form, pa.string()), pa.array(kind, pa.string())], names=["ref", "words", "form", "kind"])

    return entries.mapInArrow(spell, "ref long, words array<string>, form string, kind string")


def list_blocks(canon: DataFrame, ref_id: str, name: str, block_entries: int = BLOCK_ENTRIES, qualifiers: frozenset[str] = QUALIFIERS) -> Iterator[Matcher]:
    """The canonical list in blocks of about block_entries entries, one after the other; only one is on the driver at a time.

    Several rows of one ref are aliases of it. A form that is the full name of an entry names that one (the smallest ref
    of several); any other form that fits several entries names none.
    """
    entries = canon.select(F.col(ref_id).cast("long").alias("ref"), F.col(name).alias("name")).where("ref IS NOT NULL AND name IS NOT NULL")
    forms = cut(_forms(entries, qualifiers))
    named = forms.groupBy("form").agg(F.min(F.when(F.col("kind") == "full", F.col("ref"))).alias("own"), F.min("ref").alias("low"), F.max("ref").alias("high"))
    named = cut(named.withColumn("ref", F.coalesce("own", F.when(F.col("low") == F.col("high"), F.col("low")))).where("ref IS NOT NULL").select("form", "ref"))
    short = forms.where("kind = 'short'").select("form", "ref", "words").join(named, ["form", "ref"], "left_semi").select("ref", "words").distinct().withColumn("short", F.lit(True))
    whole = cut(forms.where("kind = 'full'").select("ref", "words").distinct().join(short, ["ref", "words"], "left"))
    blocks = max(1, ceil(whole.count() / block_entries))
    block = F.pmod(F.xxhash64("ref"), F.lit(blocks))
    for k in range(blocks):
        rows = whole.where(block == k).collect()
        yield Matcher([(r.ref, tuple(r.words), bool(r.short)) for r in rows], [(r.form, r.ref) for r in named.where(block == k).collect()])


def match_names(
    df: DataFrame, row_id: str, value: str, canon: DataFrame, ref_id: str, name: str, hot_rows: int = HOT_ROWS, block_entries: int = BLOCK_ENTRIES, qualifiers: frozenset[str] = QUALIFIERS
) -> DataFrame:
    """(row_id, value, ref_id, way, similarity) for each row whose value is neither null nor empty nor itself a name of the list.

    ref_id is -1 for values that name no entry, such as part of a two-word one. Names of the list may have any number of
    words, share words and come in any number. Of equally similar entries the smallest ref wins. Equal values are matched
    once, so a value in a third of all rows costs no more; rows meet their value's match in a salted join. Long values are
    used whole; an empty list matches nothing, an empty table gives an empty result. qualifiers: words to leave out.
    """
    rows = df.select(F.col(row_id).alias("i"), F.col(value).alias("v")).where("v IS NOT NULL AND v <> ''")
    exact = bounded(cut(canon.select(F.col(name).alias("v")).where("v IS NOT NULL").distinct()))
    counts = cut(rows.groupBy("v").agg(F.count("*").alias("n")).join(exact, "v", "left_anti"))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, ceil(counts.count() / VALUES_A_TASK))
    values, found = counts.select("v").repartition(tasks), None
    for block in list_blocks(canon, ref_id, name, block_entries, qualifiers):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matcher = _worker_matcher(shared)
            for batch in batches:
                refs, ways, sure, order = zip(*[matcher.match(v, qualifiers) for v in batch.column(0).to_pylist()], strict=True) if batch.num_rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(refs, pa.int64()), pa.array(ways, pa.string()), pa.array(sure, pa.float64()), pa.array(order, pa.float64())], names=["v", "ref", "way", "similarity", "order"])

        part = cut(values.mapInArrow(scan, "v string, ref long, way string, similarity double, order double"))
        shared.unpersist()
        found = part if found is None else cut(found.unionByName(part).groupBy("v").agg(F.min(F.struct("order", "ref", "way", "similarity")).alias("b")).select("v", "b.ref", "b.way", "b.similarity", "b.order"))
    joined = salted_join(rows, found.drop("order"), ["v"], hot_keys(counts, ["v"], "n", hot_rows), F.col("i").cast("int"))
    return joined.select(F.col("i").alias(row_id), F.col("v").alias(value), F.col("ref").alias(ref_id), "way", "similarity")
