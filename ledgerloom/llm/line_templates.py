"""Line dedup by a log-template tree of fixed depth.

A line's way through the tree is its token count, then its two leading tokens; a mirrored tree takes the two last ones.
Tokens that are variable by their looks (digits, addresses) are masked from the start.  At a leaf, which may hold many
lines, a token is constant in its place if enough of the leaf's documents have it there; all others are fields.  So a
line's template is its constant tokens, with any number of open places.  A template that enough documents hold is
dropped from all of them but the first.  The same goes for lines that are equal, or equal but for masked tokens; long
ones need few documents: two where they are equal, three where they are masked.

Nothing is gathered by leaf: leaves, places of leaves and templates are counted, each by a hash of its own and with
partial counts, so a leaf that a third of all documents share is a row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, run_hashes, slices
from .substring_dedup import mix

#: Documents that must hold a template; shortest line that has one.
MIN_DOCS, MIN_TOKENS = 12, 3
#: Lines of so many tokens are long; documents that must hold one, as it is and masked.
LONG_TOKENS, LONG_DOCS, LONG_MASKED_DOCS = 8, 2, 3
#: Of a line's tokens at least this share must be constant, else the template says nothing.
CONSTANT = 0.6
#: Of a leaf's documents at least this share must have a constant token in its place, and must hold a template found by such
#: tokens.  Leaves of common beginnings ("It is") grow with the corpus, so there chance alone never makes a template.
LEAF_SHARE = 0.1
#: Tables are sent to all executors up to so many rows (24 bytes each); beyond, they are joined.
MAX_SENT = 1_000_000
#: Of a table that is joined, a bit for each key is sent, so that only what may be in it takes part: 64 bits a key up to so many words.
MAX_WORDS = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VARIABLE = np.zeros(256, bool)
_VARIABLE[[*range(48, 58), 64]] = True
_ANY = np.uint64(0x5851F42D4C957F2D)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: What a hash stands for, in its two lowest bits: a template of MIN_DOCS, of LONG_DOCS, of LONG_MASKED_DOCS; a leaf.
SHORT, EQUAL, MASKED, LEAF = range(4)


def _kind(h: np.ndarray, kind) -> np.ndarray:
    return (h & ~np.uint64(3) | np.asarray(kind).astype(np.uint64)).view(np.int64)


class Lines:
    """The lines of some texts: which text each is of, and its hashes, as (line, hash) pairs of templates (with ``whole_lines``) and of leaves."""

    def __init__(self, texts: list[str], whole_lines: bool = True):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raws) + b" \0\0", np.uint8)
        breaks = np.flatnonzero(data == 10)
        begins = np.append(0, breaks + 1)
        of_text = np.cumsum(np.append(0, [len(r) + 1 for r in raws]))[: len(raws)]
        self.doc = np.searchsorted(of_text, begins, "right") - 1
        self.no = np.arange(len(begins)) - np.searchsorted(begins, of_text)[self.doc] if raws else np.empty(0, np.int64)
        body = data[: len(data) - 3]
        starts, h = run_hashes(body, ~_SPACE[body])
        h = mix(h)
        line = np.searchsorted(begins, starts, "right") - 1
        self.size = np.bincount(line, minlength=len(begins))
        self.start = np.cumsum(self.size) - self.size
        pos = np.arange(len(starts)) - self.start[line]
        odd = _VARIABLE[body]
        slashes = np.flatnonzero(data[:-3] == 58)
        slashes = slashes[(data[slashes + 1] == 47) & (data[slashes + 2] == 47)]
        if len(slashes):
            odd = odd.copy()
            odd[slashes] = True
        odd_at = np.flatnonzero(odd)
        variable = np.zeros(len(starts), bool)
        variable[np.searchsorted(starts, odd_at, "right") - 1] = True
        at = starts[data[starts] == 119]
        at = at[(data[np.minimum(at + 3, len(data) - 1)] == 46) & (data[at + 1] == 119) & (data[at + 2] == 119)]
        variable[np.searchsorted(starts, at)] = True
        self.token = np.where(variable, _ANY, h)
        self.at = mix(pos.astype(np.uint64) * _K1 + np.uint64(1))

        some = np.flatnonzero(self.size)
        n, first = self.size[some], self.start[some]
        fixed = n - (np.add.reduceat(variable.astype(np.int64), first) if len(some) else 0)
        long, tree = n >= LONG_TOKENS, (n >= MIN_TOKENS) & (fixed >= CONSTANT * n)
        self.leaf_line = some[tree]
        a, z = first[tree], (first + n)[tree] - 1
        size = n[tree].astype(np.uint64)
        self.leaves = [_kind(mix(mix(self.token[x] + size * _K1) + self.token[y] * salt), LEAF) for x, y, salt in ((a, a + 1, _K2), (z, z - 1, _K3))]
        if not whole_lines:
            return
        whole = lambda tokens, salt: mix(np.add.reduceat(mix(tokens ^ self.at), first) + n.astype(np.uint64) * salt) if len(some) else np.empty(0, np.uint64)
        literal, masked = whole(h, _K2), whole(self.token, _K3)
        pairs = [
            (some, _kind(literal, np.where(long, EQUAL, SHORT)), long | ~tree),
            (some, _kind(masked, SHORT), tree & ~long),
            (some, _kind(masked, MASKED), tree & long & (fixed < n)),
        ]
        self.template_line, self.template = (np.concatenate([p[k][p[2]] for p in pairs]) for k in (0, 1))

    def open_leaves(self, leaves: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, leaf, whether it goes by the last tokens, documents asked for) where enough documents hold the leaf."""
        line, leaf = np.concatenate([self.leaf_line] * 2), np.concatenate(self.leaves)
        found, at = leaves.find(leaf)
        return line[found], leaf[found], np.flatnonzero(found) >= len(self.leaf_line), leaves.values[at[found]]

    def sifted_leaves(self, leaves: Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, leaf, whether it goes by the last tokens) where enough documents may hold the leaf."""
        line, leaf = np.concatenate([self.leaf_line] * 2), np.concatenate(self.leaves)
        found = leaves.passes(leaf)
        return line[found], leaf[found], np.flatnonzero(found) >= len(self.leaf_line)

    def cells(self, line: np.ndarray, leaf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """For (line, leaf) pairs one after another: which pair each token is of, the token's place in this slice, which of
        them have to be counted, and for these the hash of leaf, place and token.

        Masked tokens are never constant, and the two tokens that a leaf goes by always are: all of its documents have them.
        """
        size = self.size[line]
        pair = np.repeat(np.arange(len(line)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        token = np.repeat(self.start[line], size) + place
        own = np.where(np.repeat(last, size), place >= np.repeat(size - 2, size), place < 2)
        asked = np.flatnonzero(~own & (self.token[token] != _ANY))
        to = token[asked]
        return pair, token, asked, mix(mix(self.token[to] ^ self.at[to]) + leaf[pair[asked]].view(np.uint64)).view(np.int64)

    def opened(self, line: np.ndarray, leaf: np.ndarray, last: np.ndarray, frequent: Table) -> tuple[np.ndarray, np.ndarray]:
        """The template by constant places of each (line, leaf) pair, and whether it says enough."""
        pair, token, asked, cell = self.cells(line, leaf, last)
        if not len(pair):
            return np.empty(0, np.int64), np.empty(0, bool)
        constant = self.token[token] != _ANY
        constant[asked] = frequent.find(cell)[0]
        starts = np.cumsum(self.size[line]) - self.size[line]
        h = mix(np.add.reduceat(mix(np.where(constant, self.token[token], _ANY) ^ self.at[token]), starts) + leaf.view(np.uint64))
        return _kind(h, SHORT), np.add.reduceat(constant.astype(np.int64), starts) >= CONSTANT * self.size[line]

    def sifted(self, line: np.ndarray, leaf: np.ndarray, last: np.ndarray, frequent: Sieve) -> tuple[np.ndarray, ...]:
        """Of the (line, leaf) pairs whose template says enough if all cells that pass are frequent: line, leaf, the shape that
        none of them is part of, its constant tokens, how many cells pass; then, for one pair after another, these cells and
        what each changes in the shape (by exclusive or)."""
        pair, token, asked, cell = self.cells(line, leaf, last)
        if not len(pair):
            return line[:0], leaf[:0], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), cell[:0], cell[:0]
        named, at = self.token[token], self.at[token]
        constant = named != _ANY
        constant[asked] = False
        starts = np.cumsum(self.size[line]) - self.size[line]
        shape = np.bitwise_xor.reduceat(mix(np.where(constant, named, _ANY) ^ at), starts)
        fixed = np.add.reduceat(constant.astype(np.int64), starts)
        passed = frequent.passes(cell)
        asked, cell = asked[passed], cell[passed]
        some = np.bincount(pair[asked], minlength=len(line))
        good = fixed + some >= CONSTANT * self.size[line]
        kept = good[pair[asked]]
        asked, cell = asked[kept], cell[kept]
        change = mix(named[asked] ^ at[asked]) ^ mix(_ANY ^ at[asked])
        return line[good], leaf[good], shape[good].view(np.int64), fixed[good], some[good], cell, change.view(np.int64)


class Table:
    """Sorted 64-bit keys with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


class Sieve:
    """A bit for each of many 64-bit keys.  All of them pass, and few others: at most one in 64 while there is a word for each key."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def passes(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64)
        word = self.words[(h >> np.uint64(8) & np.uint64(len(self.words) - 1)).view(np.int64)]
        return (word >> (h >> np.uint64(2) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sieve(keys: DataFrame, key: str) -> Sieve:
    """Bits are set where the keys are, and at most ``MAX_WORDS`` words come to the driver."""
    size = min(MAX_WORDS, 1 << keys.count().bit_length())
    word = F.shiftright(key, 8).bitwiseAND(F.lit(size - 1).cast("long")).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(`{key}`, 2) & 63L as int))")
    got = keys.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return Sieve(words)


def _table(df: DataFrame, key: str, value: str) -> Table:
    got = df.select(key, value).toArrow()
    values = got.column(1)
    return Table(got.column(0).to_numpy(), values.to_numpy() if pa.types.is_integer(values.type) and not values.null_count else np.array([*values.to_pylist(), None], object)[:-1])


def _once(doc: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Rows without repeats of (doc, first column), by document."""
    key = mix(columns[0].view(np.uint64) + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    first = first[np.argsort(doc[first], kind="stable")]
    return [x[first] for x in (doc, *columns)]


def _held(docs: DataFrame, make: Callable[[Lines], tuple[np.ndarray, ...]], names: list[str], whole_lines: bool = True) -> DataFrame:
    """``__id`` and ``names`` (longs), for each text the distinct rows that ``make(lines)`` gives: (doc, columns...)."""
    keyed = docs.select("__id", F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), 1000, 1 << 22):
                doc, *columns = _once(*make(Lines(batch.column(1).slice(at, n).to_pylist(), whole_lines)))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(pa.array(doc)), *map(pa.array, columns)], names=["__id", *names])

    return keyed.mapInArrow(run, f"__id {keyed.schema['__id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


def recurring_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``template, n, first, leaf``: held by at least as many rows of ``docs`` as its kind asks for, and the smallest doc_id."""

    def make(lines: Lines) -> tuple[np.ndarray, ...]:
        line = np.concatenate([lines.template_line, *[lines.leaf_line] * 2])
        return lines.doc[line], np.concatenate([lines.template, *lines.leaves])

    held = _held(docs.select(F.col("doc_id").alias("__id"), "text"), make, ["template"])
    kind = F.col("template").bitwiseAND(3)
    least = F.when(kind == EQUAL, min(LONG_DOCS, min_docs)).when(kind == MASKED, min(LONG_MASKED_DOCS, min_docs)).otherwise(min_docs)
    counted = held.groupBy("template").agg(F.count("*").alias("n"), F.min("__id").alias("first")).where(F.col("n") >= least)
    return counted.select("template", F.greatest(F.lit(min_docs), F.ceil(F.col("n") * LEAF_SHARE)).cast("long").alias("asked"), "first", (kind == LEAF).alias("leaf"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_sent: int = MAX_SENT) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and ``n_lines, n_dropped`` beside its other columns.

    A line goes where its template is held by ``min_docs`` rows or more (long lines: LONG_DOCS, and LONG_MASKED_DOCS
    masked) and a smaller doc_id holds it too; so what recurs stays once.  Null ids come after all others and never are
    the first; what only rows without an id hold stays.  Rows that repeat an id are all first or none.  Null text stays
    null and has no lines; a document may end up empty but its row stays.  Other columns pass through; ours replace
    columns of the same names.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(*[docs[f"`{c}`"] for c in others])
    recurring = cut(recurring_templates(base, min_docs))
    sizes = {r["leaf"]: r["count"] for r in recurring.groupBy("leaf").count().collect()}
    if sizes.get(True, 0) > max_sent:
        return _drop_by_join(base, recurring, min_docs)
    # Whole lines that recur are as many as the corpus has copies of; they are joined alone, without tokens.
    joined = sizes.get(False, 0) > max_sent
    spark, keyed = docs.sparkSession, base.select(F.col("doc_id").alias("__id"), "text")
    sent = recurring.where("not leaf").where(F.lit(not joined))
    box = spark.sparkContext.broadcast((_table(sent, "template", "first"), _table(recurring.where("leaf"), "template", "asked")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0), 1000, 1 << 22):
                lines = Lines(batch.column(0).slice(at, n).to_pylist(), False)
                line, leaf, last, asked = lines.open_leaves(box.value[1])
                pair, _, which, cell = lines.cells(line, leaf, last)
                pair = pair[which]
                _, cell, asked = _once(lines.doc[line[pair]], cell, asked[pair])
                cell, first, held = np.unique(cell, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(asked[first].astype(np.int64)), pa.array(held)], names=["cell", "asked", "n"])

    found = keyed.where("text is not null").select(F.col("text").cast("string")).mapInArrow(places, "cell long, asked long, n long")
    cells = cut(found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).where("n >= asked"))
    if cells.count() > max_sent:
        return _drop_by_join(base, recurring, min_docs, cells)
    box_cells = spark.sparkContext.broadcast(_table(cells, "cell", "n"))

    def templates(lines: Lines) -> tuple[np.ndarray, ...]:
        line, leaf, last, asked = lines.open_leaves(box.value[1])
        template, good = lines.opened(line, leaf, last, box_cells.value)
        return lines.doc[line[good]], template[good], asked[good]

    opened = cut(_held(keyed, templates, ["template", "asked"], False).groupBy("template").agg(F.count("*").alias("n"), F.max("asked").alias("asked"), F.min("__id").alias("first")).where("n >= asked"))
    if opened.count() > max_sent:
        return _drop_by_join(base, recurring, min_docs, cells)
    box_opened = spark.sparkContext.broadcast(_table(opened, "template", "first"))
    at_text, at_id = others.index("text"), others.index("doc_id")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(at_text), 1000, 1 << 22):
                part = batch.slice(at, n)
                texts, ids = part.column(at_text).to_pylist(), part.column(at_id).to_pylist()
                lines = Lines([t or "" for t in texts], not joined)
                if joined:
                    lines.template_line, lines.template = np.empty(0, np.int64), np.empty(0, np.int64)
                found, place = box.value[0].find(lines.template)
                line, first = lines.template_line[found], box.value[0].values[place[found]] if len(box.value[0].keys) else np.empty(0)
                leaf_line, leaf, last, _ = lines.open_leaves(box.value[1])
                template, good = lines.opened(leaf_line, leaf, last, box_cells.value)
                hit, where = box_opened.value.find(template)
                hit &= good
                line = np.concatenate([line, leaf_line[hit]])
                first = [*first, *(box_opened.value.values[where[hit]] if len(box_opened.value.keys) else ())]
                gone: dict[int, set[int]] = {k: set(x) for k, x in enumerate(part.column(len(others)).to_pylist()) if x} if joined else {}
                for own, doc, no, least in zip(line.tolist(), lines.doc[line].tolist(), lines.no[line].tolist(), first, strict=True):
                    if least is not None and (ids[doc] is None or least < ids[doc]):
                        gone.setdefault(doc, set()).add(no)
                for doc, lost in gone.items():
                    texts[doc] = "\n".join(x for k, x in enumerate(texts[doc].split("\n")) if k not in lost)
                held = np.bincount(lines.doc, minlength=n)
                counts = [0 if t is None else int(k) for t, k in zip(texts, held, strict=True)]
                arrays = [pa.array(texts, pa.string()) if i == at_text else part.column(i) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array([len(gone.get(k, ())) for k in range(n)], pa.int64())], names=[*others, "n_lines", "n_dropped"])

    texts = base.withColumn("text", F.col("text").cast("string"))
    if joined:
        texts = _with_gone(texts, recurring.where("not leaf"))
    return texts.mapInArrow(drop, ", ".join(f"`{c}` {'string' if c == 'text' else base.schema[c].dataType.simpleString()}" for c in others) + ", n_lines long, n_dropped long")


def _with_gone(texts: DataFrame, recurring: DataFrame) -> DataFrame:
    """``texts`` and ``__gone``: the numbers of lines that a smaller doc_id holds as a whole, by a join of hashes."""
    keyed = _keyed(texts)
    box = texts.sparkSession.sparkContext.broadcast(_sieve(recurring, "template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(3), 1000, 1 << 22):
                part, lines = batch.slice(at, n), Lines(batch.column(3).slice(at, n).to_pylist())
                found = box.value.passes(lines.template)
                line = lines.template_line[found]
                of = pa.array(lines.doc[line])
                yield pa.RecordBatch.from_arrays([part.column(1).take(of), part.column(2).take(of), pa.array(lines.no[line].astype(np.int32)), pa.array(lines.template[found])], names=["__id", "__text", "line", "template"])

    held = keyed.mapInArrow(run, f"__id {keyed.schema['__id'].dataType.simpleString()}, __text long, line int, template long")
    return _join_gone(texts, held.join(recurring.select("template", "first"), "template"))


def _keyed(base: DataFrame) -> DataFrame:
    """``__row`` (which only what is made in one pass may go by), ``__id``, ``__text`` (a hash of the text) and ``text`` of the rows that have one."""
    text = F.col("text").cast("string")
    return base.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__text"), text.alias("text")).where("text is not null")


def _join_gone(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``texts`` and ``__gone``: the lines of ``hits`` (``__id, __text, line, first``) that a smaller doc_id holds.

    Rows meet again by id and a hash of the text: what goes from a row depends on nothing else.  Texts are dealt out, but not sorted.
    """
    later = F.col("first").isNotNull() & (F.col("__id").isNull() | (F.col("first") < F.col("__id")))
    gone = hits.where(later).groupBy("__id", "__text").agg(F.collect_set("line").alias("__gone"))
    whole = texts.select("*", F.xxhash64(F.col("text").cast("string")).alias("__own"))
    return whole.join(gone.hint("shuffle_hash"), whole["doc_id"].eqNullSafe(gone["__id"]) & (whole["__own"] == gone["__text"]), "left").select(*texts.columns, "__gone")


def _drop_by_join(base: DataFrame, recurring: DataFrame, min_docs: int, cells: DataFrame | None = None) -> DataFrame:
    """The same where tables are too large to be sent: bits of their keys are, and what passes them is joined, as hashes alone.

    A template is the leaf and the exclusive or of its places, so the frequent cells of a line that were found by a join make
    it up without the line's tokens.  ``cells``: the frequent tokens, if they are counted already.
    """
    spark, keyed = base.sparkSession, _keyed(base)
    leaves, whole = recurring.where("leaf").select(F.col("template").alias("leaf"), "asked"), recurring.where("not leaf").select("template", "first")
    box_leaves = spark.sparkContext.broadcast(_sieve(leaves, "leaf"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(0), 1000, 1 << 22):
                lines = Lines(batch.column(0).slice(at, n).to_pylist(), False)
                line, leaf, last = lines.sifted_leaves(box_leaves.value)
                pair, _, which, cell = lines.cells(line, leaf, last)
                pair = pair[which]
                _, cell, leaf = _once(lines.doc[line[pair]], cell, leaf[pair])
                cell, first, held = np.unique(cell, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(leaf[first]), pa.array(held)], names=["cell", "leaf", "n"])

    if cells is None:
        found = keyed.select("text").mapInArrow(places, "cell long, leaf long, n long")
        counted = found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("leaf").alias("leaf")).where(F.col("n") >= min_docs)
        cells = cut(counted.join(leaves, "leaf").where("n >= asked").select("cell"))
    box_cells, box_whole = (spark.sparkContext.broadcast(_sieve(d, c)) for d, c in ((cells, "cell"), (whole, "template")))
    named = {"__row": "long", "__id": keyed.schema["__id"].dataType.simpleString(), "__text": "long", "line": "int", "key": "long", "shape": "long", "fixed": "long", "size": "long", "cells": "array<long>", "changes": "array<long>"}

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole lines (of size 0) and pairs of line and leaf that may recur."""
        for batch in batches:
            for at, n in slices(batch.column(3), 1000, 1 << 22):
                part, lines = batch.slice(at, n), Lines(batch.column(3).slice(at, n).to_pylist())
                same = box_whole.value.passes(lines.template)
                pair, leaf, shape, fixed, some, cell, change = lines.sifted(*lines.sifted_leaves(box_leaves.value), box_cells.value)
                none = np.zeros(int(same.sum()), np.int64)
                line = np.concatenate([lines.template_line[same], pair])
                of, ends = pa.array(lines.doc[line]), pa.array(np.cumsum(np.concatenate([[0], none, some])).astype(np.int32))
                numbers = [np.concatenate([lines.template[same], leaf]), *(np.concatenate([none, x]) for x in (shape, fixed, lines.size[pair]))]
                arrays = [*(part.column(k).take(of) for k in range(3)), pa.array(lines.no[line].astype(np.int32)), *map(pa.array, numbers), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cell, change))]
                yield pa.RecordBatch.from_arrays(arrays, names=list(named))

    sifted = cut(keyed.mapInArrow(sift, ", ".join(f"{c} {kind}" for c, kind in named.items())))
    pairs, place = sifted.where("size > 0"), ["__row", "line", "key"]
    each = pairs.select(*place, F.explode(F.arrays_zip("cells", "changes")).alias("x")).select(*place, F.col("x.cells").alias("cell"), F.col("x.changes").alias("change"))
    frequent = each.join(cells.select("cell"), "cell").groupBy(*place).agg(F.count("*").alias("n"), F.bit_xor("change").alias("change"))
    told = pairs.join(frequent, place, "left").where(F.col("fixed") + F.coalesce("n", F.lit(0)) >= CONSTANT * F.col("size"))
    told = told.withColumnRenamed("key", "leaf").join(leaves, "leaf").withColumn("shape", F.col("shape").bitwiseXOR(F.coalesce("change", F.lit(0).cast("long"))))
    told = cut(told.select("__row", "__id", "__text", "line", "leaf", "asked", "shape"))
    template = ["leaf", "shape"]
    opened = told.select("__row", "__id", "asked", *template).distinct().groupBy(*template).agg(F.count("*").alias("n"), F.max("asked").alias("asked"), F.min("__id").alias("first")).where("n >= asked").select(*template, "first")
    hit = ["__id", "__text", "line", "first"]
    hits = sifted.where("size = 0").withColumnRenamed("key", "template").join(whole, "template").select(hit).union(told.join(opened, template).select(hit))
    columns = base.columns
    at_text = columns.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(at_text), 1000, 1 << 22):
                part = batch.slice(at, n)
                texts = part.column(at_text).to_pylist()
                held = [0 if t is None else t.count("\n") + 1 for t in texts]
                gone = [set(x or ()) for x in part.column(len(columns)).to_pylist()]
                texts = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) if lost else t for t, lost in zip(texts, gone, strict=True)]
                arrays = [pa.array(texts, pa.string()) if i == at_text else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(held, pa.int64()), pa.array(list(map(len, gone)), pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    texts = _join_gone(base.withColumn("text", F.col("text").cast("string")), hits)
    return texts.mapInArrow(drop, ", ".join(f"`{c}` {'string' if c == 'text' else base.schema[c].dataType.simpleString()}" for c in base.columns) + ", n_lines long, n_dropped long")


def digest(dropped: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of the documents after the lines went."""

    def make(texts: list[str]) -> dict:
        return {"kept_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]}

    return per_text(dropped, ["doc_id", "n_lines", "n_dropped"], "text", make, "kept_sha256 string")
