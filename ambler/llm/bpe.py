"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

``compile_lexicon`` builds the minimal acyclic automaton of a sorted word list.
Common suffixes share states; the output of a word, summed along its arcs, is its
rank, and a table by rank holds its token ids.  The automaton is an array file
that workers map into memory.  Encoding cuts a text into words as the vocabulary's
own rules do, walks all new words of a batch through the automaton at once, and
merges words it lacks exactly, with the vocabulary's merge list.  A worker keeps
the ids of words it has met in a table of bounded size.

Texts whose characters all lie below U+0300 are lower-cased and cut with a
precompiled expression; any other text is normalized and cut by the vocabulary's
normalizer and pre-tokenizer.  Both give the same words where both apply.  Strings
of special tokens inside a text become those tokens, as the library has it.

Edge cases: null text is empty and has no ids; repeated rows are encoded alike; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import itertools
import json
import os
import re
import shutil
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.llm.common import in_arrow, slices, table
from ambler.llm.textblock import Words, same_bytes

VOCABULARY = "word_bpe_49k.json"
#: Most words in the compiled lexicon, and words, runs and bytes of runs that a worker remembers
#: (a batch may go over by its own).
LEXICON_WORDS = 65_536
CACHE_WORDS = 250_000
CACHE_RUNS = 1_000_000
CACHE_BYTES = 32 << 20
#: Runs that a task counts before it passes their words on.
COUNT_RUNS = 400_000
_PLAIN = 0x300
_SLICE = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if test(chr(c)))


@functools.lru_cache(maxsize=1)
def _plain_words() -> re.Pattern:
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    space = r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


_UNPLAIN = re.compile("[\u0130\u0300-\U0010ffff]")


class Automaton:
    """Minimal acyclic transducer from words (bytes) to their rank in sorted order."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.targets, self.adds, self.final = (arrays[k] for k in ("keys", "targets", "adds", "final"))

    @staticmethod
    def compile(words: list[bytes]) -> dict[str, np.ndarray]:
        """Arrays of the automaton of a sorted list of distinct words (incremental minimization)."""
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = []
        finals: list[bool] = []

        def frozen(final: bool, out: dict[int, int]) -> int:
            key = (final, *out.items())
            if key not in register:
                register[key] = len(arcs)
                arcs.append(out)
                finals.append(final)
            return register[key]

        # The path of the word last added: [final, arcs so far]; a child is frozen when the path leaves it.
        path: list[list] = [[False, {}]]
        last = b""
        for word in words:
            shared = len(os.path.commonprefix([last, word]))
            while len(path) > shared + 1:
                final, out = path.pop()
                path[-1][1][last[len(path) - 1]] = frozen(final, out)
            for _ in range(len(word) - shared):
                path.append([False, {}])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, out = path.pop()
            path[-1][1][last[len(path) - 1]] = frozen(final, out)
        root = frozen(*path[0])
        # Words below each state; a state's children have smaller numbers.
        below = np.zeros(len(arcs), np.int64)
        rows = []
        for state, out in enumerate(arcs):
            total = int(finals[state])
            for label, target in out.items():
                rows.append((state * 256 + label, target, total))
                total += int(below[target])
            below[state] = total
        rows.sort()
        keys, targets, adds = np.array(rows, np.int64).reshape(-1, 3).T
        return {
            "keys": np.ascontiguousarray(keys),
            "targets": targets.astype(np.int32),
            "adds": adds.astype(np.int32),
            "final": np.array(finals),
            "root": np.array([root], np.int64),
        }

    def rank(self, words: list[bytes], root: int) -> np.ndarray:
        """Rank of each word, -1 where the automaton lacks it; all words advance together."""
        lens = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(words) else lens
        state, total = np.full(len(words), root, np.int64), np.zeros(len(words), np.int64)
        active = np.flatnonzero(lens > 0)
        step = 0
        while len(active) and len(self.keys):
            key = state[active] * 256 + data[first[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[active] = np.where(found, self.targets[at], -1)
            total[active] += np.where(found, self.adds[at], 0)
            step += 1
            active = active[found]
            active = active[lens[active] > step]
        # A word left early at a missing arc has state -1.
        ended = state >= 0
        ended[ended] = self.final[state[ended]]
        if not len(self.keys):
            ended &= lens == 0
        return np.where(ended, total, -1)


def compile_lexicon(words: list[str], tokenizer, folder: str) -> str:
    """Write automaton and id table of ``words`` as one file of arrays; returns its path."""
    words = sorted(w.encode() for w in words)
    arrays = Automaton.compile(words)
    ids = [_merge(tokenizer, w.decode()) for w in words]
    arrays["bounds"] = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    arrays["ids"] = np.array(list(itertools.chain.from_iterable(ids)), np.int32)
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [at, str(x.dtype), len(x)]
        at += -(-x.nbytes // 64) * 64
    front = json.dumps(head).encode().ljust(1024)
    with open(path, "wb") as out:
        out.write(front)
        for name, x in arrays.items():
            out.seek(1024 + head[name][0])
            out.write(x.tobytes())
        out.truncate(1024 + at)
    return path


def _mapped(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    head = json.loads(whole[:1024].tobytes())
    return {k: whole[1024 + at : 1024 + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in head.items()}


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
_CHAR_BYTES = {c: b for b, c in _BYTE_CHARS.items()}


def _merge(tokenizer, word: str) -> list[int]:
    """Exact merges of one word."""
    shown = word if word.isascii() and word.isprintable() else "".join(_BYTE_CHARS[b] for b in word.encode())
    return [t.id for t in tokenizer.model.tokenize(shown)]


class Runs:
    """Numbers runs between ASCII white space, without a Python object per run.

    No token spans white space, so a run's ids don't depend on what stands around it.
    Runs are looked up by their 64-bit hashes and compared byte by byte with the run that
    has the number; one that only shares its hash is numbered by its bytes.
    """

    def __init__(self):
        self.hashes, self.numbers, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.held, self.start, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clashes: dict[bytes, int] = {}

    def _add(self, words: Words, chosen: np.ndarray) -> list[str]:
        """Keep the bytes of new runs, numbered from the old size on; returns their texts."""
        pieces = [words.data[a:b] for a, b in zip(words.start[chosen].tolist(), words.end[chosen].tolist(), strict=True)]
        lengths = words.end[chosen] - words.start[chosen]
        self.start = np.concatenate([self.start, len(self.held) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.held = np.concatenate([self.held, *pieces])
        self.size += len(chosen)
        return [p.tobytes().decode() for p in pieces]

    def number(self, words: Words) -> tuple[np.ndarray, list[str]]:
        """The number of every run, and the texts of the new ones, numbered from the old size on."""
        distinct, first, inverse = _distinct(words.hash)
        at = np.searchsorted(self.hashes, distinct)
        inside = np.minimum(at, max(len(self.hashes) - 1, 0))
        known = self.hashes[inside] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        numbers = np.empty(len(distinct), np.int64)
        numbers[known] = self.numbers[inside[known]]
        fresh = np.flatnonzero(~known)
        numbers[fresh] = self.size + np.arange(len(fresh))
        self.hashes = np.insert(self.hashes, at[fresh], distinct[fresh])
        self.numbers = np.insert(self.numbers, at[fresh], numbers[fresh])
        texts = self._add(words, first[fresh])
        found = numbers[inverse]
        size = words.end - words.start
        same = size == self.length[found]
        same[same] = same_bytes(words.data, words.start[same], self.held, self.start[found[same]], size[same])
        for i in np.flatnonzero(~same):
            run = words.data[words.start[i] : words.end[i]].tobytes()
            if run not in self.clashes:
                self.clashes[run] = self.size
                texts += self._add(words, np.array([i]))
            found[i] = self.clashes[run]
        return found, texts


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each first stands, and each value's number."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class Encoder:
    """Whole texts to token ids, equal to the library's ids without added tokens."""

    def __init__(self, path: str, lexicon: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = _plain_words()
        self.lexicon = _mapped(lexicon) if lexicon else None
        self.automaton = Automaton(self.lexicon) if lexicon else None
        self._clear()

    def _clear(self) -> None:
        self.runs, self.ids = Runs(), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known: dict[str, list[int]] = {}

    def _cut(self, text: str) -> list[str]:
        lowered = text.lower()
        if _UNPLAIN.search(text) or _UNPLAIN.search(lowered):
            normal = self.tokenizer.normalizer.normalize_str(text)
            return [
                bytes(_CHAR_BYTES[c] for c in piece).decode()
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            ]
        return self.words.findall(lowered)

    def cut_words(self, text: str) -> list[str]:
        """The words of a text, by the vocabulary's rules; special tokens are words."""
        if self.cut is None or "<" not in text:
            return self._cut(text)
        parts = self.cut.split(text)
        return list(itertools.chain.from_iterable([p] if i % 2 else self._cut(p) for i, p in enumerate(parts)))

    def _learn(self, runs: list[str]) -> None:
        """Ids of new runs: new words by the automaton, those it lacks by merging."""
        cut = [self.cut_words(r) for r in runs]
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        ranks = np.full(len(new), -1)
        if self.automaton is not None and new:
            ranks = self.automaton.rank([w.encode() for w in new], int(self.lexicon["root"][0]))
            bounds, ids = self.lexicon["bounds"], self.lexicon["ids"]
        for word, rank in zip(new, ranks.tolist(), strict=True):
            if word in self.special:
                known[word] = [self.special[word]]
            elif rank >= 0:
                known[word] = ids[bounds[rank] : bounds[rank + 1]].tolist()
            else:
                known[word] = _merge(self.tokenizer, word)
        found = [[i for w in words for i in known[w]] for words in cut]
        counts = np.array([len(x) for x in found], np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, counts.sum())])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column end to end, and the bounds of each row's."""
        if self.runs.size > CACHE_RUNS or len(self.runs.held) > CACHE_BYTES:
            self._clear()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = Words(texts, lower=False)
        numbers, new = self.runs.number(words)
        if new:
            self._learn(new)
        counts = self.count[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.first[numbers] - ends[:-1], counts)
        at += np.arange(ends[-1])
        return self.ids[at], ends[words.bounds]


class Decoder:
    """Token ids to text as the library does for a vocabulary without a decoder: tokens joined by spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder of their own are supported")
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [(tokenizer.id_to_token(i) or "").encode() + b" " for i in range(size)]
        self.count = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        counts = self.count[ids]
        ends = np.cumsum(counts)
        if not len(ends):
            return b""
        at = np.repeat(self.first[ids] - (ends - counts), counts) + np.arange(ends[-1])
        return self.bytes[at[:-1]].tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path, lexicon)


@functools.lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _count_words(path: str, most: int):
    """mapInArrow: word, n; counts are passed on whenever ``most`` runs are held."""

    def told(cutter, texts, totals):
        counts = {}
        for text, n in zip(texts, totals.tolist(), strict=False):
            for word in cutter.cut_words(text):
                counts[word] = counts.get(word, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        cutter = encoder(path)
        runs, texts, totals = Runs(), [], np.zeros(0, np.int64)
        for batch in slices(batches, "text", _SLICE):
            numbers, new = runs.number(Words(batch.column("text"), lower=False))
            texts += new
            seen = np.bincount(numbers, minlength=runs.size)
            seen[: len(totals)] += totals
            totals = seen
            if runs.size > most or len(runs.held) > CACHE_BYTES:
                yield told(cutter, texts, totals)
                runs, texts, totals = Runs(), [], np.zeros(0, np.int64)
        if texts:
            yield told(cutter, texts, totals)

    return run


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> list[str]:
    """At most ``most`` words, the commonest of the whole table.

    The least count that still fits is read off a histogram of counts, so that
    only the chosen words reach the driver.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = (
        in_arrow(texts, _count_words(path, COUNT_RUNS), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    ).persist()
    level = F.least(F.floor(F.log2("n") * 16), F.lit(1023)).cast("int")
    histogram = {r.level: r.words for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    fits, held = 1024, 0
    for at in sorted(histogram, reverse=True):
        held += histogram[at]
        if held > most:
            break
        fits = at
    words = [r.word for r in counts.where(level >= fits).select("word").collect()]
    counts.unpersist()
    return words


def _encode(path: str, lexicon: str | None):
    """mapInArrow: doc_id, ids (unsigned 32-bit little-endian), decoded text."""

    def run(batches):
        from pyspark import SparkFiles

        coder = encoder(path, SparkFiles.get(lexicon) if lexicon else None)
        back = decoder(path)
        for batch in slices(batches, "text", _SLICE):
            ids, bounds = coder.encode_batch(batch.column("text"))
            coded, texts = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                coded.append(ids[a:b].astype("<u4").tobytes())
                texts.append(back.decode(ids[a:b]))
            yield batch.column("doc_id"), np.diff(bounds), coded, texts

    return run


def encode(docs: DataFrame, lexicon: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids as little-endian 32-bit integers, decoded text of every row."""
    path = path or vocabulary_path()
    rows = _encode(path, lexicon)

    def run(batches):
        for doc_id, n, coded, texts in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(n), pa.array(coded, pa.binary()), pa.array([t.decode() for t in texts], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return in_arrow(
        docs.select("doc_id", F.col("text").cast("string").alias("text")),
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string"
    )


def digest(docs: DataFrame, lexicon: str | None = None, path: str | None = None) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of ids and text, made in the same pass."""
    path = path or vocabulary_path()
    rows = _encode(path, lexicon)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_id, n, coded, texts in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(n), pa.array(map(sha, coded), pa.string()), pa.array(map(sha, texts), pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(
        docs.select("doc_id", F.col("text").cast("string").alias("text")),
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def ship_lexicon(docs: DataFrame, path: str | None = None, most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs`` and send the file to all executors; returns its name there."""
    from tokenizers import Tokenizer

    path = path or vocabulary_path()
    folder = tempfile.mkdtemp(prefix="ambler-lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = compile_lexicon(frequent_words(docs, path, most), Tokenizer.from_file(path), folder)
    docs.sparkSession.sparkContext.addFile(file)
    return os.path.basename(file)


def op4_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs, ship_lexicon(docs))
