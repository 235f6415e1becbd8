"""The pipeline on a small fixture against plain Python, stage by stage."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from support import DATA
from test_dedup import brute, edited, shingles
from test_text import base, gram_hash, language, mixed, plain_grams
from util import prose, table

import corpus_pipeline as pipeline
from ambler.llm import bpe, langid, quality, substring_dedup
from ambler.llm.common import materialize
from ambler.llm.textblock import Words


def fixture():
    r = random.Random(9)
    passage = prose(77, 60)
    rows = [(i, prose(i, r.randrange(60, 260)), "en") for i in range(40)]
    rows += [(100 + i, language(1, i, 120), "ru") for i in range(30)]
    rows += [(200 + i, edited(rows[i][1], 1, i), "en") for i in range(8)]
    rows += [(300 + i, prose(400 + i, 70) + " " + passage + " " + prose(500 + i, 50), "en") for i in range(6)]
    rows += [(400, None, None), (401, "", "en"), (402, "12 34 " * 40, "en"), (403, "too short", "en"), (404, "ab cd " * 200, "en"), (405, prose(0, 100), None)]
    rows += [(500, rows[3][1], "en"), (500, rows[3][1], "en")]
    return rows


def by_language(rows, model):
    """Every n-gram looked up on its own, in plain sets of table bits."""
    kept = []
    for doc_id, text in rows:
        if not text or not any(c.isalpha() for c in text):
            continue
        hashes = [gram_hash(g) for g in plain_grams(text)]
        hits = np.zeros(len(model.langs))
        for h in hashes:
            mask = ~0
            for i in range(langid.HASHES):
                mask &= int(model.tables[0][(h >> (20 * i)) % langid.TABLE_WORDS])
            for b in range(len(hits)):
                hits[b] += mask >> b & 1
        score = ((hits - len(hashes) * model.wrong) / (1 - model.wrong)).max() / max(len(hashes), 1)
        if score >= langid.MIN_SCORE:
            kept.append((doc_id, text))
    return kept


def by_quality(rows):
    def fits(held):
        low, high = quality._limits(len(held), quality.BANDS)
        return low <= len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(held)) / len(held) <= high

    kept = []
    for doc_id, text in rows:
        n, _, _, _, repeated = base(text)
        held = text.encode()
        chunks = [held[i : i + quality.CHUNK_BYTES] for i in range(0, len(held), quality.CHUNK_BYTES)]
        bad = sum(len(c) for c in chunks if len(held) > quality.CHUNK_BYTES and not fits(c))
        if n >= 50 and 100 * repeated <= 50 * n and fits(held) and 2 * bad <= len(held):
            kept.append((doc_id, text))
    return kept


def without_copies(rows):
    rows = sorted(set(rows))
    return [row for row, (_, _, component) in zip(rows, (dict((x[0], x) for x in brute(rows, Fraction(80, 100)))[i] for i, _ in rows)) if row[0] == component]


def plain_chunks(text):
    """(words, first byte, end byte) of every chunk, word by word."""
    held = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", held)]
    values = []
    for _, end in spans:
        h = 0
        for byte in held[max(0, end - 32) : end]:
            h = (2 * h + int(substring_dedup._GEAR[byte])) % 2**32
        values.append(mixed(h))
    n, reach = len(spans), substring_dedup.REACH
    ends, begun, since = [], None, 0
    for i, v in enumerate(values):
        lowest = all(0 <= i - d and v < values[i - d] and i + d < n and v <= values[i + d] for d in range(1, reach + 1))
        if any(i >= d and values[i - d] == v for d in range(1, reach + 1)):
            begun = i if begun is None else begun
        else:
            begun = None
        since += 1
        if lowest or i == n - 1 or since == substring_dedup.LONGEST or (begun is not None and (i - begun) % substring_dedup.PERIODIC == 0):
            ends.append(i)
            since = 0
    firsts = [0, *(e + 1 for e in ends[:-1])]
    return [(tuple(held[a:b] for a, b in spans[f : e + 1]), spans[f][0], spans[e][1]) for f, e in zip(firsts, ends)]


def windows(chunks):
    return [c[0] for c in chunks] if len(chunks) == 1 else [(a[0], b[0]) for a, b in zip(chunks, chunks[1:])]


def test_chunks_equal_plain_python():
    same = ["a " * 500, "| --- | " * 90, "", "x", " ".join(f"w{i}" for i in range(700)), "é\u3000ü " * 40 + prose(9, 300), "ab\ncd " * 100 + prose(4, 20)]
    texts = [prose(i, 3 + 37 * i) for i in range(25)] + same
    words = Words(pa.array(texts), lower=False)
    chunks = substring_dedup.Chunks(words)
    names = {}
    for i, text in enumerate(texts):
        expected = plain_chunks(text)
        at = range(chunks.bounds[i], chunks.bounds[i + 1])
        got = [(int(words.start[chunks.first[c]] - words.offsets[i]), int(words.end[chunks.last[c]] - words.offsets[i])) for c in at]
        assert got == [c[1:] for c in expected], repr(text[:60])
        for c, (held, _, _) in zip(at, expected):
            assert names.setdefault(int(chunks.digest[c]), held) == held
    assert len(set(names.values())) == len(names)


def without_passages(rows):
    cut = {i: plain_chunks(t) for i, t in rows}
    first = {}
    for i in sorted(cut):
        for w in windows(cut[i]):
            first.setdefault(w, i)
    out = []
    for i, text in rows:
        chunks = cut[i]
        marked = [first[w] != i for w in windows(chunks)]
        dup = [any(marked[max(0, c - 1) : c + 1]) for c in range(len(chunks))]
        held, k = text.encode(), 0
        keep, last = [], 0
        while k < len(dup):
            end = k
            while end < len(dup) and dup[end]:
                end += 1
            if end > k and sum(len(c[0]) for c in chunks[k:end]) >= substring_dedup.MIN_WORDS:
                keep.append(held[last : chunks[k][1]])
                last = chunks[end - 1][2]
            k = max(end, k + 1)
        out.append((i, b"".join([*keep, held[last:]]).decode()))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, fixture())
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], DATA), "stage"))
    return found


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_equals_plain_python(spark, stages):
    rows = [(i, t) for i, t, _ in fixture()]
    model = langid.train(langid.training_rows(stages[0]))
    assert pairs(stages[1]) == sorted(by_language(rows, model))
    assert pairs(stages[2]) == sorted(by_quality(pairs(stages[1])))
    assert pairs(stages[3]) == sorted(without_copies(pairs(stages[2])))
    assert pairs(stages[4]) == sorted(without_passages(pairs(stages[3])))
    for before, after in zip(stages[:4], stages[1:5]):
        assert before.columns == after.columns
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packed_tokens_are_those_of_the_texts(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    packed = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.doc_id, r.start)):
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for doc_id, text in pairs(stages[4]):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        place = 0
        for start, length, crc in packed.pop(doc_id):
            assert start == place and crc == zlib.crc32(ids[start : start + length].tobytes())
            place += length
        assert place == len(ids)
    assert not packed


def test_near_copies_and_passages_are_caught_and_clean_documents_stay(stages):
    left = dict(pairs(stages[4]))
    assert not {200 + i for i in range(8)} & set(left) and 500 not in left
    assert set(range(40)) <= set(left) and {100 + i for i in range(30)} <= set(left)
    passage = prose(77, 60)
    assert passage in left[300] and all(passage not in left[300 + i] for i in range(1, 6))
    assert all(left[i] == t for i, t, _ in fixture()[:40])
    assert shingles(left[300]) and not {400, 401, 402, 403, 404} & set(left)


def test_run_over_a_table_and_over_nothing(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert pipeline.run(spark, DATA).where("length <= 0").count() == 0
