"""Spelling variants: rare words go to a much more frequent word that is one edit away.

A word is cut into two halves.  Whatever single code point is inserted, deleted or replaced, one half stands unchanged in
the other word: the first at its start, or the second at its end.  Automaton shards hold the halves of all words, each half
in the shard of its hash, length of word and end; every word is scanned by the (at most six) shards that could hold what it
starts or ends with, a hit counts only where its place and the words' lengths fit, and what is left beside the half is
compared.  Halves that many words share are looked up by halves of the rest, again and again.

The work so grows with the words, not with words times shards.  A half that more than ``HOT`` words share is dealt out by
the halves of the rest, too, so no task holds all of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, n_partitions, slices

#: Code points that a word must have, and occurrences.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form has at least so many times the occurrences of the word.
FACTOR = 10
#: One run in so many loses a code point.
ONE_IN = 31
#: Halves that a shard holds at most, as far as hashes deal them out evenly, and words of one half before it is dealt out further.
SHARD, HOT = 50_000, 2_000
#: Words that share all but a stretch are compared one by one up to this number.
FEW = 16

# All characters of a run are single bytes in Latin-1; whatever else a text holds becomes "?", one for one.
_RUNS = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % MIN_LENGTH)


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``MIN_LENGTH``, A-Z lower-cased, in Latin-1.

    A shorter run cannot make a word: a run only ever loses a code point.
    """
    return _RUNS.findall(text.encode("latin-1", "replace").translate(ASCII_LOWER))


def altered(doc: str, run: bytes) -> bytes:
    """The run, without one code point where the checksum of document and run says so."""
    h = zlib.crc32(run.decode("latin-1").encode(), zlib.crc32(f"{doc}:".encode("utf-8", "surrogatepass")))
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``MIN_LENGTH`` code points with their occurrences over all texts.

    Null text: none; a null id is written as an empty text.  Counts are added up within each slice of texts, then before
    the shuffle, then by word.
    """
    keyed = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                total: Counter[bytes] = Counter()
                for doc, t in zip(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist(), strict=True):
                    for word, k in Counter(runs(t)).items() if t else ():
                        total[altered(doc, word)] += k
                kept = [(w.decode("latin-1"), k) for w, k in total.items() if len(w) >= MIN_LENGTH]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], names=["word", "n"])
        pa.default_memory_pool().release_unused()

    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between ``a`` and ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Stretch:
    """Owners that agree everywhere but in one stretch (of one length), found by what they have there."""

    def __init__(self):
        self.rests: list[tuple[str, int]] = []
        self.left: dict[str, Stretch] = {}
        self.right: dict[str, Stretch] = {}

    def add(self, rest: str, owner: int) -> None:
        self.rests.append((rest, owner))

    def near(self, other: str, found: set[int]) -> None:
        """Adds the owners whose stretch is one edit from ``other``."""
        size = len(self.rests[0][0])
        if len(self.rests) <= FEW or size < 2:
            found.update(owner for rest, owner in self.rests if one_edit(rest, other))
            return
        half = size // 2
        if not self.left:
            self.left, self.right = defaultdict(Stretch), defaultdict(Stretch)
            for rest, owner in self.rests:
                self.left[rest[:half]].add(rest[half:], owner)
                self.right[rest[half:]].add(rest[:half], owner)
        if inner := self.left.get(other[:half]):
            inner.near(other[half:], found)
        at = len(other) - (size - half)
        if at >= 0 and (inner := self.right.get(other[at:])):
            inner.near(other[:at], found)


class Shard:
    """The automaton over halves of words: ``(word, end, finer)`` rows of owners.

    ``end``: 0 for the first half, 1 for the second.  ``finer``: 0, or of a half that many share, 1 or 2 for the half of
    the rest by which the owner was dealt to this shard.
    """

    def __init__(self, owners: list[tuple[str, int, int]]):
        import ahocorasick

        self.words = [word for word, _, _ in owners]
        halves: dict[str, dict[tuple[int, int, int], Stretch]] = defaultdict(lambda: defaultdict(Stretch))
        for owner, (word, end, finer) in enumerate(owners):
            half = len(word) // 2
            segment, rest = (word[half:], word[:half]) if end else (word[:half], word[half:])
            halves[segment][end, len(word), finer].add(rest, owner)
        self.automaton = ahocorasick.Automaton()
        for segment, kinds in halves.items():
            self.automaton.add_word(segment, (len(segment), [(*kind, stretch) for kind, stretch in kinds.items()]))
        self.automaton.make_automaton()

    def near(self, word: str) -> list[int]:
        """Places of the owners one edit from ``word``.  What both halves would find counts for the first."""
        out: list[int] = []
        size = len(word)
        for at, (length, kinds) in self.automaton.iter(word):
            if at != length - 1 and at != size - 1:
                continue
            for end, of, finer, stretch in kinds:
                if not -2 < size - of < 2 or at != (size - 1 if end else length - 1):
                    continue
                rest = word[: size - length] if end else word[length:]
                found: set[int] = set()
                stretch.near(rest, found)
                for owner in found:
                    own = self.words[owner]
                    if end and word.startswith(own[: of // 2]):
                        continue
                    if finer:
                        theirs = own[: of // 2] if end else own[of // 2 :]
                        same = rest.startswith(theirs[: len(theirs) // 2])
                        if same != (finer == 1) or finer == 2 and not rest.endswith(theirs[len(theirs) // 2 :]):
                            continue
                    out.append(owner)
        return out


def _halves(words: DataFrame, scanned: bool) -> DataFrame:
    """``word, n, size, end, half, rest``: the halves of every word, or what stands in their place in a word that is scanned
    for words of its own length (``size``), one less and one more."""
    length = F.char_length("word")
    sized = words.withColumn("size", F.explode(F.array(*[length + d for d in (-1, 0, 1)])) if scanned else length)
    both = sized.withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.floor(F.col("size") / 2).cast("int"), F.ceil(F.col("size") / 2).cast("int")
    at = F.when(F.col("end") == 0, first).otherwise(length - second)  # where the word is cut
    left, right = F.substring("word", F.lit(1), at), F.substring("word", at + 1, length)
    is_end = F.col("end") == 1
    return both.select("word", "n", "size", "end", F.when(is_end, right).otherwise(left).alias("half"), F.when(is_end, left).otherwise(right).alias("rest"))


def _finer(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` of halves that many words share twice, with ``finer`` 1 and 2 and what stands in place of a half of the rest in ``part``."""
    key = ["size", "end", "half"]
    marked = rows.join(hot.select(*key, F.lit(True).alias("hot")), key, "left")
    theirs = F.when(F.col("end") == 1, F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2)).cast("int")  # length of the owners' rest
    first = F.floor(theirs / 2).cast("int")
    finer = marked.withColumn("finer", F.explode(F.when(F.col("hot"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    length = F.char_length("rest")
    start = F.greatest(length - (theirs - first), F.lit(0))
    part = F.when(F.col("finer") == 1, F.substring("rest", F.lit(1), first)).when(F.col("finer") == 2, F.substring("rest", start + 1, length)).otherwise("")
    return finer.withColumn("part", part).drop("hot")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n`` for each of ``words`` (``word, n``, distinct) that has near words: how many, and the
    most frequent of them (the smallest in code-point order of several), with its occurrences."""
    n = n_partitions(words)
    shards = n * max(1, -(-2 * words.count() // (SHARD * n)))
    owners, scanned = _halves(words, False), _halves(words, True)
    hot = cut(owners.groupBy("size", "end", "half").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    if hot.limit(1).count():
        owners, scanned = _finer(owners, hot), _finer(scanned, hot)
    else:
        owners, scanned = (d.withColumns({"finer": F.lit(0), "part": F.lit("")}) for d in (owners, scanned))
    shard = F.pmod(F.xxhash64("size", "end", "half", "finer", "part"), F.lit(shards)).alias("shard")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("end", "int"), ("finer", "int"), ("n", "long"))]
    # A word is scanned once by a shard, whatever it may find there.
    once = scanned.select("word", shard).groupBy("word").agg(F.collect_set("shard").alias("shards"))
    dealt = owners.select(shard, F.lit(0).alias("scanned"), "word", "end", "finer", "n").union(once.select(F.explode("shards"), F.lit(1), "word", *none))
    dealt = dealt.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "scanned", "word")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, owners, counts, shard = None, [], [], None
        for batch in batches:
            out: list[tuple[str, int, str, int]] = []
            for at, scanned, word, end, finer, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != number:
                    number, owners, counts, shard = at, [], [], None
                if not scanned:
                    owners.append((word, end, finer))
                    counts.append(n)
                    continue
                if not owners:
                    continue
                if shard is None:
                    shard = Shard(owners)
                if near := shard.near(word):
                    best = min(near, key=lambda k: (-counts[k], owners[k][0]))
                    out.append((word, len(near), owners[best][0], counts[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "near", "near_n"])

    found = dealt.mapInArrow(scan, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("fewer"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.fewer")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each of ``word, form``: the last of the forms that follow one another.

    Each round doubles the steps; occurrences grow tenfold with each step, so five rounds do.
    """
    found = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = found.join(on, "root", "left")
        longer = cut(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), instead_of=found)
        if not longer.where("moved").limit(1).count():
            return longer.select("word", "root")
        found = longer


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences: ``word, form, root, n, n_near, form_n``.

    Null and empty texts have no words; repeated rows count as often as they stand; a null id is written as an empty text
    in the checksum; columns other than ``key`` and ``text`` are not read.  Of near words with equal occurrences the
    smallest in code-point order is the form.
    """
    words = cut(word_counts(docs, key, text).where(F.col("n") >= MIN_COUNT))
    near = near_words(words)
    enough = F.col("near_n") >= FACTOR * F.col("n")
    chosen = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")
    )
    chosen = cut(chosen)
    root = roots(chosen.where("form is not null").select("word", "form"))
    return chosen.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
