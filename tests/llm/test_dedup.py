"""Near-duplicate classes and substring dedup against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from util import DOCS, ODD, WORD, prose, store, table, with_clashes

from ambler.llm import near_dedup, substring_dedup
from ambler.llm.common import connected_components


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and both >= threshold * total:
                up[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        out.append((doc_id, len(sets[i]), (min(known) if known else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def edited(text, n, seed):
    words, r = text.split(), random.Random(seed)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def classes(docs, threshold=Fraction(85, 100)):
    rows = near_dedup.near_duplicate_classes(docs, threshold).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_odd_documents(spark, tmp_path):
    assert classes(with_clashes(table(spark, ODD))) == brute(ODD, Fraction(85, 100))
    folder = store(spark, tmp_path, "documents", table(spark, ODD))
    got = near_dedup.op2_minhash_near_dedup(spark, folder)
    assert got.count() == len(ODD)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect() if r.doc_id is not None)


def test_empty_table(spark):
    assert classes(table(spark, [])) == []
    assert near_dedup.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_groups_near_the_threshold(spark, monkeypatch, block):
    """Pairs on both sides of the limit, chains, and hubs whose leaves are not linked with each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows, base = [], {g: prose(100 + g, 150) for g in range(6)}
    for g, text in base.items():
        rows += [(1000 * g + i, edited(text, n, 31 * g + i)) for i, n in enumerate([0, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 9] * 2)]
    chain = prose(500, 200)
    for i in range(12):
        rows.append((9000 + i, chain))
        chain = edited(chain, 2, i)
    random.Random(3).shuffle(rows)
    assert classes(table(spark, rows)) == brute(rows, Fraction(85, 100))


def test_exact_similarity_at_the_limit(spark):
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words[:104]), " ".join(words[8:112])  # 92 of 108 common: 0.8518
    c = " ".join(words[200:304])
    d = " ".join(words[209:313])  # 91 of 109: 0.8348
    assert classes(table(spark, [(1, a), (2, b), (3, c), (4, d)])) == [(1, 100, 1), (2, 100, 1), (3, 100, 3), (4, 100, 4)]


@pytest.mark.parametrize("r, m, shift", [(3, 18, 11), (3, 14, 8)])
def test_pairs_at_the_limit_share_a_bucket(r, m, shift):
    """2,000 pairs of sets a little over 0.80 (89 of 111) and 0.85 (92 of 108): two collections must be equal."""
    n = 2000
    texts = [" ".join(f"w{i}x{j}" for j in range(a, a + 104)) for i in range(n) for a in (0, shift)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n)), pa.array([0] * 2 * n), pa.array(texts)], ["doc_id", "h", "text"])
    keys = np.array([k for b in near_dedup._signatures(5, r, m)([batch]) for k in b.column("keys").to_pylist()])
    found = (keys[0::2] == keys[1::2]).sum(axis=1) >= 2
    assert found.mean() >= 0.999


def test_patterns_of_words_are_no_copies(spark):
    def thue_morse(a, b):
        one, two = [a], [b]
        for _ in range(10):
            one, two = one + two, two + one
        return one, two

    letters = ["".join(t) for t in thue_morse("a", "b")]
    rows = [(i, " ".join([t] * 3 + [f"x{j}" for j in range(3)])) for i, t in enumerate(letters)]
    assert {c for _, _, c in classes(table(spark, rows))} == {0, 1}
    texts = [" ".join([prose(9 + i, 30), t, prose(20 + i, 30)]) for i, t in enumerate(letters)]
    assert all(not r["__spans"] for r in substring_dedup.dedupe(table(spark, list(enumerate(texts)))).collect())


def test_keep_one_row_of_each_class(spark):
    docs = with_clashes(table(spark, ODD))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, None, None]))


def test_large_group_of_copies_and_repeated_rows(spark):
    rows = [(i, prose(7, 60)) for i in range(400)] + [(5000, prose(8, 60))] * 300
    assert {c for _, _, c in classes(table(spark, rows))} == {0, 5000}
    assert near_dedup.keep_one(table(spark, rows)).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (300, 301)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 180)}, 300: 300, 301: 300}


# --- substrings


def deduped(spark, rows):
    docs = with_clashes(table(spark, rows))
    done = substring_dedup.dedupe(docs)
    assert done.columns == [*docs.columns, "__spans"]
    return sorted(((r.doc_id, r.text, r["__spans"]) for r in done.collect()), key=str)


def test_planted_passages_go_wherever_they_begin(spark):
    passage = [prose(900 + k, 51) for k in range(8)]
    rows = []
    for i in range(120):
        own = prose(i, 120 + i).split()
        cut = 11 + (i * 7) % 90
        rows.append((i, " ".join(own[:cut]) + (" " if i % 2 else "\n") + passage[i % 8] + " " + " ".join(own[cut:])))
    rows += [(200 + i, prose(2000 + i, 150)) for i in range(40)]
    for doc_id, text, spans in deduped(spark, rows):
        before = dict(rows)[doc_id]
        if 8 <= doc_id < 200:
            left = set(WORD.findall(text)) & set(passage[doc_id % 8].split())
            assert passage[doc_id % 8] not in text
            assert spans and len(left) < 40, doc_id
            assert all(k % 8 == doc_id % 8 and k < doc_id for s in spans for k in s.keepers)
            own = prose(doc_id, 120 + doc_id)
            assert len(WORD.findall(text)) >= len(own.split())
        else:
            assert text == before and not spans


def test_odd_documents_keep_their_rows(spark, tmp_path):
    got = deduped(spark, ODD)
    assert len(got) == len(ODD)
    texts = {}
    for doc_id, text, _ in got:
        texts.setdefault(doc_id, []).append(text)
    assert texts[1] == [None] and texts[2] == [""] and texts[6] == [prose(1, 200)] * 2
    assert texts[9] == [prose(2, 30_000)] and texts[11] == ["same " * 300]
    assert sorted(texts[None], key=str) == sorted([prose(3, 80), None], key=str)
    folder = store(spark, tmp_path, "documents", table(spark, ODD))
    assert substring_dedup.op9_gear_substring_dedup(spark, folder).count() == len(ODD)
    assert deduped(spark, []) == []


def test_copies_lose_their_text_to_the_least_id(spark):
    rows = [(i, prose(5, 300)) for i in (3, 1, 2)]
    got = {i: (t, s) for i, t, s in deduped(spark, rows)}
    assert got[1][0] == prose(5, 300) and got[2][0].strip() == got[3][0].strip() == ""
    assert sum(s.words for s in got[2][1]) == 300


def test_chunks_meet_again_after_an_insertion():
    from ambler.llm.textblock import Words

    text = prose(1, 2000)
    words = text.split()
    one = substring_dedup.Chunks(Words(pa.array([text]), lower=False))
    two = substring_dedup.Chunks(Words(pa.array([" ".join([*words[:1000], "inserted", *words[1000:]])]), lower=False))
    assert len(set(one.digest) - set(two.digest)) <= 3
    assert one.size.sum() == 2000 and one.size[:-1].min() >= 4 and one.size.max() <= substring_dedup.LONGEST
    same = substring_dedup.Chunks(Words(pa.array(["a " * 500, "", None, "b"]), lower=False))
    assert same.size.max() <= substring_dedup.LONGEST and same.size.sum() == 501 and same.bounds[-1] == len(same.size)


def test_every_word_of_a_chunk_counts():
    from ambler.llm.textblock import Words

    words = ["same"] * substring_dedup.LONGEST
    texts = [" ".join(words)] + [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(len(words))]
    for text in texts[1:]:
        one, two = (substring_dedup.Chunks(Words(pa.array([t]), lower=False)) for t in (texts[0], text))
        assert not set(one.digest) & {d for d, n in zip(two.digest, two.size) if n == substring_dedup.LONGEST}


def test_chunks_do_not_depend_on_other_rows():
    from ambler.llm.textblock import Words

    texts = [prose(i, 5 + 17 * i) for i in range(30)] + ["", None, "x", "a b"]
    many = substring_dedup.Chunks(Words(pa.array(texts), lower=False))
    for i, text in enumerate(texts):
        one = substring_dedup.Chunks(Words(pa.array([text], pa.string()), lower=False))
        assert many.digest[many.bounds[i] : many.bounds[i + 1]].tolist() == one.digest.tolist()


@pytest.mark.parametrize("unit", ["same", "| --- |", "ab cd", "."])
def test_periodic_text_is_cut_wherever_it_begins(unit):
    from ambler.llm.textblock import Words

    passage = " ".join((unit.split() * 90)[:90])
    texts = [" ".join([prose(i, 20 + i), passage, prose(100 + i, 30)]) for i in range(40)]
    chunks = substring_dedup.Chunks(Words(pa.array(texts), lower=False))
    digests, sizes, bounds = chunks.windows()
    first = set(digests[: bounds[1]].tolist())
    for i in range(1, 40):
        at = range(bounds[i], bounds[i + 1])
        assert sum(int(sizes[k]) for k in at if int(digests[k]) in first) >= 60, i


def test_schema_helper(spark):
    assert table(spark, ODD).schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
    assert table(spark, ODD).where(F.col("text").isNull()).count() == 2
