"""Spelling variants of a corpus: words that differ by one inserted, deleted or replaced letter, grouped under the frequent form.

Every word gets the hashes of what is left after each deletion of one code point, made for all words of a batch at once from prefix
and suffix polynomial hashes (64-bit integers, vectorised in NumPy). The keys are dealt by their upper bits (radix) and sorted by
Spark; a streaming pass over the sorted keys forms the groups of one key and checks them on the strings, so that two strings with
one hash are told apart. Two words of one length that leave the same string by deleting at the same place differ in that place; a word
that is what another leaves differs from it by an insertion. A group holds at most one word for each letter that can stand in its
gap, and only its count and its two most frequent words are used, never its pairs; so no work grows with the square of a group.

Null texts have no words, and a null id counts as the text ''. Repeated rows count each, empty tables give empty results, whole
texts are read, and further columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One run in so many (by a checksum of document and run) loses a letter.
DROPS = 199
#: Words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Bits of a key that deal it to a partition, and the odd base of the polynomial hashes (any would do).
RADIX_BITS, BASE = 16, np.uint64(0x9E3779B97F4A7C15)


def words_of(doc_id, text: str, least: int, drops: int | None) -> Iterator[tuple[str, int]]:
    """(word, count) of a text: runs of letters in lower case; a run that the checksum chooses has lost one letter."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), head) if drops else 1
            if drops and h % drops == 0:
                run = run[: (k := h % len(run))] + run[k + 1 :]
                if len(run) < least:
                    continue
            yield run, n


def vocabulary(docs: DataFrame, least: int = LETTERS, occurrences: int = OCCURRENCES, drops: int | None = DROPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least so many code points and occurrences. Tasks count before the shuffle."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py(), least, drops):
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    parts = text_of(docs, id_col, text_col).select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, key): for every word its own hash (place -1) and the hash of what each deletion leaves.

    With H(w) = sum of w[i] * BASE^i, deleting place i leaves prefix(i) + suffix(i + 1) / BASE; equal strings have equal keys.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    most = int(lengths.max()) if len(words) else 0
    powers = np.ones(most + 1, np.uint64)
    np.cumprod(np.full(most, BASE, np.uint64), out=powers[1:])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    terms = codes * powers[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    whole = sums[ends] - sums[starts]
    prefix = sums[starts[owner] + place] - sums[starts[owner]]
    suffix = whole[owner] - prefix - terms
    left = prefix + suffix * inverse
    # the length goes into the key, so that what is left of long and short words hardly ever meets
    fold = lambda h, n: mix(h ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    number = np.concatenate([np.arange(len(words)), owner])
    return number, np.concatenate([np.full(len(words), -1), place]), np.concatenate([fold(whole, lengths), fold(left, lengths[owner] - 1)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits, as the radix takes the upper ones; the constants are those of a common finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def entries(words: DataFrame) -> DataFrame:
    """(radix, key, place, word, n) of every word and every deletion."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, len(batch), 4096):
                own = batch.slice(lo, 4096)
                number, place, key = deletion_keys(own.column(0).to_pylist())
                at = pa.array(number)
                radix = pa.array((key >> np.uint64(64 - RADIX_BITS)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([radix, pa.array(key.view(np.int64)), pa.array(place, pa.int32()), own.column(0).take(at), own.column(1).take(at)], ["radix", "key", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(make, "radix int, key long, place int, word string, n long")


def left_of(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def neighbours(members: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, how many near words it has here, n and word of the most frequent of them) among the (place, word, n) of one key.

    Members are first parted by what is really left of them. Then words meet at each place (replacements), and the word that is
    itself what is left meets each other one once (insertions): of places in a run of one letter only the first counts.
    """
    parts: dict[str, list] = {}
    for place, word, n in members:
        parts.setdefault(left_of(word, place), []).append((place, word, n))
    for part in parts.values():
        if len(part) < 2:
            continue
        gaps: dict[int, list] = {}
        whole, longer = None, []
        for place, word, n in part:
            if place < 0:
                whole = (n, word)
            else:
                gaps.setdefault(place, []).append((n, word))
                if place == 0 or word[place] != word[place - 1]:
                    longer.append((n, word))
        best = lambda found: min(found, key=lambda f: (-f[0], f[1]))
        for found in gaps.values():
            if len(found) > 1:
                top = best(found)
                second = best([f for f in found if f is not top])
                for f in found:
                    yield f[1], len(found) - 1, *(second if f is top else top)
        if whole and longer:
            yield whole[1], len(longer), *best(longer)
            for f in longer:
                yield f[1], 1, *whole


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of all words with near ones: how many, and the most frequent (of equals the first by code points)."""

    def sweep(batches: Iterator) -> Iterator:
        """Over keys in order; the members of the last key wait for the next batch."""
        import pyarrow as pa

        def out(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])

        waiting, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            found: list = []
            if last is not None and keys[0] != last:
                found += neighbours(waiting)
                waiting = []
            # keys that stand alone need no look at their strings, unless the batch's ends may cut them
            several = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1 or a == 0 or b == len(keys)]
            take = np.concatenate([np.arange(a, b) for a, b in several])
            rows = iter(list(zip(*(batch.column(k).take(pa.array(take)).to_pylist() for k in (1, 2, 3)))))
            for a, b in several:
                own = [next(rows) for _ in range(b - a)]
                waiting = waiting + own if a == 0 else own
                if b < len(keys):
                    found += neighbours(waiting)
                    waiting = []
            last = keys[-1]
            yield out(found)
        yield out(list(neighbours(waiting)))

    dealt = entries(words).repartition("radix").sortWithinPartitions("key").select("key", "place", "word", "n")
    found = dealt.mapInArrow(sweep, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def group(docs: DataFrame, least: int = LETTERS, occurrences: int = OCCURRENCES, factor: int = FACTOR, drops: int | None = DROPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    ``form`` is the most frequent near word if it is ``factor`` times as frequent (else null), ``root`` what forms lead to in the
    end. Forms become more frequent by that factor with each step, so the longest chain follows from the largest count, and
    its logarithm is the number of joins.
    """
    tables = Tables(docs.sparkSession, "variants")
    words = tables.save(vocabulary(docs, least, occurrences, drops, id_col, text_col), "words")
    formed = F.col("best_n") >= factor * F.col("n")
    near = words.join(near_words(words), "word", "left")
    known = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    known = tables.save(known, "known")
    top = words.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(max(top / occurrences, 1), factor)) + 1)
    jumps = known.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(chain.bit_length()):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = tables.save(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"jumps{k}")
    return known.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
