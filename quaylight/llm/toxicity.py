"""Toxicity by noisy-channel restoration of disguised words.

A writer's letters reach the text through a channel that may swap a letter for a look-alike,
repeat it, or put separators between letters. Words that show such signs are turned into a
lattice (for every character: the letters it may stand for, or nothing for a separator or a
repetition, each at a cost) and decoded by Viterbi under a character trigram model; the best few
paths are kept. The restored words of a text, and the plain ones, are then looked up in weights
learned from labels.

The character model counts trigrams of every text (28**3 sums leave the tasks). The word weights
are a classifier fitted on at most FIT_ROWS labelled rows of each class, chosen by the hash of
doc_id (the documented bound) and thinned of copies: of texts whose least word-triple hashes agree
under three mixings that of the least doc_id stays; a word counts once a text. Words that occur in
at least `least` and one in a hundred of the toxic texts, at several times their rate in clean ones,
make the lexicon, if those texts are unlike each other: under each mixing alone they must still show
as many different least hashes, so a word of a group of near copies does not enter. Beside words
there are stems: STEMS leading letters that at least two different plain words of a text share; a
word that has a lexicon stem gives no evidence but the stem's. A text's score is the logistic of the
base plus the weights (log likelihood ratios) of its distinct lexicon words and, of stems that begin
one another, the largest; the base is the log-odds of the labelled texts without any. A word with
doubled letters is also tried with the doubling undone.

Scoring is one pass over whole texts inside the tasks that read them; restored words are
remembered by each worker, in a table that is emptied when it is full.

Defined results: null and empty texts get the base score, as does every text of an empty lexicon;
without labels of both classes the base is 0.05; repeated rows are scored alike; labels that repeat a
doc_id count once, by the larger label; an empty table gives an empty result; equally good decodings
are taken in the order of their letters. Very long texts are counted in chunks and scored whole.
Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, store, strings, table

FIT_ROWS, LEAST, SHARE, MEMORY, BASE, PATHS, STEMS, RATE = 8_000, 6, 0.01, 200_000, 0.05, 4, range(4, 8), 10
BORDER, SIZE = 0, 27
#: Look-alikes of letters. Fixed values.
ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
SEPARATORS = ".-_*~·,'/\\ \t"
SWAP, REPEAT, SKIP, ANY = 1.0, 0.4, 0.3, 3.5
#: Long stretches are read in windows of so many characters, each half over the next, or of four times the longest lexicon word.
WINDOW = 96
MARKS = b"@$!|+(<*#"
EDGES = "!|*#+(<"
#: Letters one by one: classes of characters, see CLASS.
OTHER = re.compile("[^\\x00-\u024f" + "".join(c for c in ALIKE if c > "\u024f") + "]+")
SPACED = re.compile(rb"(?<![a0])[a0](?:[ .]{1,2}[a0]){2,}(?![a0])")


def _classes() -> tuple[bytes, bytes]:
    """CLASS: a for letters (and all bytes beyond ASCII), 0 for digits and marks, '.' for separators, blank, ',' for the rest. WORDS: all but letters become blanks."""
    kind, words = bytearray(b"," * 256), bytearray(b" " * 256)
    for i in range(256):
        if i > 127 or chr(i).isalpha():
            kind[i], words[i] = ord("a"), i
        elif chr(i).isdigit() or i in MARKS:
            kind[i] = ord("0")
        elif chr(i) in " \t\n\r":
            kind[i] = ord(" ")
        elif chr(i) in ".-_~":
            kind[i] = ord(".")
    return bytes(kind), bytes(words)


CLASS, LETTERS = _classes()


def _symbols() -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)] = out[ord(c) - 32] = i + 1
    return out


SYMBOL = _symbols()


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as [a, b, c], over borders and 26 letters, with add-one smoothing over all texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for text in strings(batch.column(0)):
                for at in range(0, len(text or ""), 1 << 20):
                    s = SYMBOL[np.frombuffer((" " + text[max(0, at - 2) : at + (1 << 20)] + " ").encode("utf-8", "replace"), dtype=np.uint8)]
                    if len(s) > 2:
                        total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    n = np.zeros(SIZE**3)
    for r in docs.select("text").mapInArrow(add, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SIZE**3 rows at most
        n[r["code"]] = r["n"]
    n = n.reshape(SIZE, SIZE, SIZE) + 1
    return np.log(n / n.sum(axis=2, keepdims=True))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each character the (letter or nothing, cost) that it may stand for."""
    out, last = [], ""
    for c in word.lower():
        if "a" <= c <= "z":
            arcs = [(c, 0.0)]
        elif c in SEPARATORS and c not in ALIKE:
            arcs = [("", SKIP)]
        else:
            arcs = [(x, ANY if len(ALIKE[c]) > 9 else SWAP) for x in ALIKE.get(c, "")]
            if c in SEPARATORS:
                arcs.append(("", SKIP))
        if c == last:
            arcs.append(("", REPEAT))
        last = c
        out.append(arcs)
    return out


def restore(word: str, model: list, paths: int = PATHS, spaced: bool = False, glued: bool = False) -> list[str]:
    """The best few decodings by channel cost minus log probability; none where a character stands for nothing known.

    spaced: a separator may also end a word; glued: a word may end between any two characters.
    """
    steps: list[list[tuple[str, float]]] = []
    for c, arcs in zip(word, lattice(word), strict=True):
        if not arcs:
            return []
        if glued and steps:
            steps.append([("", 0.0), (" ", SWAP)])
        steps.append([*arcs, (" ", SKIP)] if spaced and c in SEPARATORS else arcs)
    beam = {(BORDER, BORDER): [(0.0, "")]}
    for arcs in steps:
        nxt: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), best in beam.items():
            for letter, cost in arcs:
                if letter:
                    s = BORDER if letter == " " else ord(letter) - 96
                    key, add = (b, s), cost - model[a][b][s]
                else:
                    key, add = (a, b), cost
                nxt.setdefault(key, []).extend((c + add, w + letter) for c, w in best)
        beam = {k: sorted(set(v))[:paths] for k, v in nxt.items()}
    ends = sorted((c - model[a][b][BORDER], w) for (a, b), v in beam.items() for c, w in v)
    return list(dict.fromkeys(w for _, w in ends if w))[:paths]


class Restorer:
    """Words of a text, plain and restored. A word that repeats letters of a lexicon word is held to that word."""

    def __init__(self, model: np.ndarray, lexicon: Iterable[str] = ()) -> None:
        self.stems = {w[:-1].encode() for w in lexicon if w.endswith("*")}
        self.lengths = sorted(set(map(len, self.stems)))
        lexicon = [w for w in lexicon if not w.endswith("*")]
        self.model, self.known, self.doubled = model.tolist(), {}, {}
        self.window = max(WINDOW, 4 * max(map(len, lexicon), default=0))
        for word in lexicon:
            for i in range(len(word)):
                for j in range(i, len(word)):
                    w = word[: i + 1] + word[i : j + 1] + word[j:] if j > i else word[: i + 1] + word[i:]
                    self.doubled[w.encode()] = word
        self.lexicon = {w.encode() for w in lexicon}

    def decoded(self, word: str, **how: bool) -> list[str]:
        key = (word, *how)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            got = self.known[key] = restore(word, self.model, 2 * PATHS if how else PATHS, **how)
        return got

    def segmented(self, text: str, **how: bool) -> set[str]:
        """Words of a stretch of any length; of a window's edges inside the stretch no word is taken, for it may be cut."""
        out, size = set(), self.window
        for at in range(0, max(1, len(text) - size // 2), size // 2):
            for path in self.decoded(text[at : at + size], **how):
                found = path.split()
                out.update(found[1 if at else 0 : -1 if at + size < len(text) else None])
        return out

    def disguised(self, low: bytes) -> set[bytes]:
        """Stretches that look disguised: letters next to look-alikes, letters one by one, a letter three times in a row."""
        kind, out = low.translate(CLASS), set()
        for sign in (b"a0", b"0a"):
            at = kind.find(sign)
            while at >= 0:
                lo, hi = at, at + 2
                while lo and kind[lo - 1] in b"a0":
                    lo -= 1
                while hi < len(kind) and kind[hi] in b"a0":
                    hi += 1
                out.add(low[lo:hi])
                at = kind.find(sign, hi)
        out.update(low[m.start() : m.end()] for m in SPACED.finditer(kind))
        b = np.frombuffer(low, dtype=np.uint8)
        if len(b) > 2:
            same = b[1:] == b[:-1]
            hi = 0
            for at in np.flatnonzero(same[1:] & same[:-1] & (b[2:] >= 97) & (b[2:] <= 122)).tolist():
                if at < hi:
                    continue
                lo = hi = at
                while lo and kind[lo - 1] == 97:
                    lo -= 1
                while hi < len(kind) and kind[hi] == 97:
                    hi += 1
                out.add(low[lo:hi])
        return out

    def restored(self, low: bytes) -> set[str]:
        out: set[str] = set()
        for raw in self.disguised(low):
            # Letters repeated over three times say no more than three; letters of other scripts end a stretch.
            whole = re.sub(r"([a-z])\1{3,}", r"\1\1\1", raw.decode("utf-8", "replace"))
            for word in OTHER.split(whole):
                # Marks at the ends are decoration where they are repeated or none that stands for a first letter.
                bare = word.rstrip(EDGES).lstrip("!|*#+(<") if word.strip("$@" + EDGES) else ""
                bare = re.sub(r"^(.)\1+(?=[^\W\d_])", r"\1", bare) if bare[:1] in ("$", "@") else bare
                bare = re.sub(r"[$@]{2,}$", "", bare)
                if not bare or bare.isdigit():
                    continue
                if bare.isalpha() and not re.search(r"(.)\1\1", bare):
                    out.add(bare)
                    continue
                if len(bare) <= self.window:
                    out.update(self.decoded(bare))
                if any(c in SEPARATORS for c in bare):
                    out.update(self.segmented(bare, spaced=True))
                else:
                    out.update(self.segmented(bare, glued=True))
        return out

    def words(self, text: str) -> set[str]:
        """Words and stems (marked by a star) of a text."""
        low = text.lower().encode("utf-8", "replace")
        plain = {w.decode("utf-8", "replace") for w in low.translate(LETTERS).split()}
        shared = Counter(w[:k] for w in plain for k in STEMS if len(w) > k)
        return plain | self.restored(low) | {f"{w}*" for w, n in shared.items() if n > 1}

    def hits(self, text: str) -> set[str]:
        """Lexicon words and stems of a text."""
        low = text.lower().encode("utf-8", "replace")
        plain = set(low.translate(LETTERS).split())
        out = {w.decode() for w in self.lexicon & plain}
        out.update(self.doubled[w] for w in self.doubled.keys() & plain)
        if self.stems:
            shared = Counter(w[:k] for k in self.lengths for w in plain if w[:k] in self.stems and len(w) > k)
            out.update(f"{w.decode()}*" for w, n in shared.items() if n > 1)
        for w in self.restored(low):
            w = w.encode("utf-8", "replace")
            if w in self.lexicon:
                out.add(w.decode())
            elif w in self.doubled:
                out.add(self.doubled[w])
        return out


def evidence(hits: set[str], weights: dict[str, float]) -> float:
    """Sum of weights; of stems that begin one another the largest alone."""
    total, stems = 0.0, []
    for w in sorted(hits, key=lambda w: (-weights[w], w)):
        if w.endswith("*"):
            if any(w[:-1].startswith(s) or s.startswith(w[:-1]) for s in stems):
                continue
            stems.append(w[:-1])
        total += weights[w]
    return total


def copy_key(text: str) -> Column:
    """Least hashes of a text's word triples under three mixings. Unlike texts share few triples, so all three agree in copies only."""
    # Arrays of one bind what is inside, which lambdas would work out again for every element.
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    triple = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    least = lambda made: F.array(*[F.array_min(F.transform(made, lambda h, n=n: F.xxhash64(h, F.lit(n)))) for n in range(3)])
    return bound(F.split(F.lower(text), "\\s+"), lambda w: F.when(w.isNotNull(), bound(triple(w), least)))


def word_weights(docs: DataFrame, labels: DataFrame, chars: np.ndarray, fit_rows: int = FIT_ROWS, least: int = LEAST) -> tuple[dict[str, float], float]:
    """Weights of lexicon words and the base log-odds, from docs (doc_id, text) and labels (doc_id, toxic), one for each doc_id."""
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if not sizes.get(0) or not sizes.get(1):
        return {}, math.log(BASE / (1 - BASE))
    share = {k: min(1.0, fit_rows / v) for k, v in sizes.items()}
    of = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    few = labels.where(F.when(F.col("toxic") == 1, of < share[1] * 1_000_000).when(F.col("toxic") == 0, of < share[0] * 1_000_000).otherwise(False))
    drawn = docs.join(F.broadcast(few), "doc_id")  # about fit_rows labels of each class at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Restorer(chars), {0: Counter(), 1: Counter()}

        def rows() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            made = [pa.array(words, pa.string()), *(pa.array([seen[k][w] for w in words], pa.int64()) for k in (0, 1))]
            for c in seen.values():
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(reader.words(text or ""))
                if len(seen[0]) + len(seen[1]) > MEMORY:
                    yield rows()
        yield rows()

    drawn = drawn.withColumn("copy", copy_key("text")).groupBy("toxic", "copy").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    drawn = store(drawn.select("text", F.col("toxic").cast("int").alias("toxic"), "copy"), "labelled")  # fit_rows texts of each class at most, about
    n = {k: 0 for k in (0, 1)} | {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        return {}, math.log(BASE / (1 - BASE))
    both = drawn.select("text", "toxic").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Rates, not counts, are compared: the classes are drawn at different shares. A word is in the lexicon if
    # even with two more clean texts its rate among toxic texts is RATE times that among clean ones. Each is in
    # one of a hundred toxic texts, so they are a hundred times the words of a text at most.
    rate, support = (F.col("toxic") / n[1]) / ((F.col("clean") + 2) / n[0]), max(least, SHARE * n[1])
    chosen = {r["word"]: (r["clean"], r["toxic"]) for r in both.where((F.col("toxic") >= support) & (rate >= RATE)).collect()}

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(chars)
        for batch in batches:
            made = [(w, *(k or [0, 0, 0])) for text, k in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True) for w in reader.words(text or "") & chosen.keys()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64() if i else pa.string()) for i in range(4)], names=["word", "k0", "k1", "k2"])

    unlike = drawn.where("toxic = 1").select("text", "copy").mapInArrow(used, "word string, k0 long, k1 long, k2 long").groupBy("word")
    unlike = {r["word"] for r in unlike.agg(*[F.count_distinct(f"k{i}").alias(f"k{i}") for i in range(3)]).collect() if min(r["k0"], r["k1"], r["k2"]) >= support}
    starts = tuple(w[:-1] for w in unlike if w.endswith("*"))
    weights = {w: math.log(((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))) for w, (clean, toxic) in sorted(chosen.items()) if w in unlike and (w.endswith("*") or not w.startswith(starts))}

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Restorer(chars, weights), [0, 0]
        for batch in batches:
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n[toxic] += not reader.hits(text or "")
        yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64())], names=["clean", "toxic"])

    bare = drawn.select("text", "toxic").mapInArrow(without, "clean long, toxic long").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    toxic, clean = ((bare[k] + 1) / n[i] * sizes[i] for k, i in (("toxic", 1), ("clean", 0)))
    return weights, math.log(toxic / clean)


def score(docs: DataFrame, chars: np.ndarray, weights: dict[str, float], base: float) -> DataFrame:
    """doc_id, held_out and score; only `text` goes into a score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Restorer(chars, weights)
        for batch in batches:
            made = [1 / (1 + math.exp(-min(30.0, base + evidence(reader.hits(t or ""), weights)))) for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.float64())], names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(each, "doc_id long, held_out boolean, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chars = character_model(docs)
    weights, base = word_weights(docs, labels, chars)
    return score(docs, chars, weights, base).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
