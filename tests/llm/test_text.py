"""BPE, language ID, packing and quality rules against libraries and brute force."""

import hashlib
import random
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from support import DATA, same_rows
from pyspark.sql import functions as F
from util import ODD, WORD, prose, store, table, with_clashes

from ambler.llm import bpe, langid, packing, quality, sql
from ambler.llm.textblock import Words

SPECIAL = [
    "<|endoftext|>hi<|startoftext|> x<|endoftext|>", "<|ENDOFTEXT|><|endoftext|", "a\x1cb\x85c\xa0d e　f",
    "Don't we'll THEY'RE x'S 'T ''s", "İ İ Σας ẞ ﬁ ǅ é ̈́", "12½²③ ٣٤ a1b2", "a\0b\x7f", "́ x \n̸<",
    "\U0001f468‍\U0001f469‍\U0001f467 ퟿￿\U0010ffff", "!!!'s---'re''", "\r\n\x0b\x0c", "日本語テスト。",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def texts():
    r = random.Random(5)
    odd = ["".join(r.choice("abcZ'!<|>€é½ \n\t\x1c\x85\xa0İ日01́_-$") for _ in range(60)) for _ in range(200)]
    odd += ["".join(chr(r.choice([r.randrange(0x300), r.randrange(0xD800), r.randrange(0x10000, 0x20000)])) for _ in range(50)) for _ in range(200)]
    return [t or "" for _, t in ODD] + SPECIAL + odd


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_encoder_equals_the_library(library, tmp_path, with_lexicon):
    own = texts()
    words = sorted({w for t in own[::2] for w in bpe.Encoder(bpe.vocabulary_path()).cut_words(t)} - {"<|endoftext|>", "<|startoftext|>"})
    lexicon = bpe.compile_lexicon(words, library, str(tmp_path)) if with_lexicon else None
    coder, back = bpe.Encoder(bpe.vocabulary_path(), lexicon), bpe.Decoder(bpe.vocabulary_path())
    for part in (own[:7], own, own[::-1]):
        ids, bounds = coder.encode_batch(pa.array(part))
        for i, text in enumerate(part):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == expected, repr(text[:80])
            assert back.decode(np.array(expected, np.int64)).decode() == library.decode(expected, skip_special_tokens=False)


def test_caches_of_any_size_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_RUNS", 50)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    coder = bpe.Encoder(bpe.vocabulary_path())
    for i in range(0, 60, 7):
        text = prose(i, 80)
        assert coder.encode_batch(pa.array([text, None]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_ranks_words_and_shares_suffixes():
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in ("", "x", "yz")} | {b"", b"a", "é".encode()})
    arrays = bpe.Automaton.compile(words)
    machine = bpe.Automaton(arrays)
    probes = [*words, b"aing!", b"q", b"ain", b"ainga"]
    assert machine.rank(probes, int(arrays["root"][0])).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(arrays["final"]) < 20
    empty = bpe.Automaton.compile([])
    assert bpe.Automaton(empty).rank([b"", b"a"], int(empty["root"][0])).tolist() == [-1, -1]


def test_encode_query_on_odd_documents(spark, tmp_path, library):
    rows = ODD + [(100 + i, t) for i, t in enumerate(SPECIAL)]
    docs = with_clashes(table(spark, rows))
    found = bpe.op4_transducer_bpe(spark, store(spark, tmp_path, "documents", docs)).collect()

    def expected(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == Counter((i, *expected(t)) for i, t in rows)
    full = bpe.encode(docs).where("doc_id = 5").first()
    assert np.frombuffer(full.ids, "<u4").tolist() == library.encode(ODD[4][1], add_special_tokens=False).ids


def test_frequent_words_are_bounded(spark):
    docs = table(spark, [(i, f"common often{i % 3} rare{i}") for i in range(50)])
    words = bpe.frequent_words(docs, bpe.vocabulary_path(), 6)
    assert {"common", "often", "rare"} <= set(words) and len(words) <= 6
    assert bpe.frequent_words(table(spark, []), bpe.vocabulary_path()) == []


def test_empty_documents(spark, tmp_path):
    folder = store(spark, tmp_path, "documents", table(spark, []))
    for query in (bpe.op4_transducer_bpe, packing.op7_concat_packing, quality.op8_compression_quality, langid.op5_bitmask_langid):
        assert query(spark, folder).collect() == []


# --- packing


@pytest.mark.parametrize("sequence", [16, 4096])
def test_pieces_tile_documents_and_sequences(spark, library, sequence):
    rows = [*ODD, (50, prose(50, 3000))]
    docs = with_clashes(table(spark, rows)).repartition(5)
    pieces = packing.pack(docs, sequence).collect()
    expected = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    at = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    place, open_, found = 0, [], Counter()
    for p in at:
        assert (p.sequence_id, p.offset) == divmod(place, sequence) and p.offset + p.length <= sequence
        assert p.start == len(open_)
        open_ += np.frombuffer(p.ids, "<u4").tolist()
        place += p.length
        if len(open_) == p.doc_tokens:
            found[p.doc_id, tuple(open_)] += 1
            open_ = []
    assert found == expected and not open_


def test_packing_query(spark):
    rows = packing.op7_concat_packing(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n != 4096 for r in full) <= 1
    one = packing.told(packing.pack(table(spark, [(1, None)]))).first()
    assert (one.length, one.ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))


# --- quality


def base(text):
    words = WORD.findall(text or "")
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, lines, len(covered)


QUALITY = [
    *ODD,
    (30, "a b c a b c a b c"), (31, "l1 x\nl1 x\n \n\nl1 x\nl2"), (32, "#*$%&|<> é#"), (33, prose(33, 40)),
    (34, prose(34, 100) + "\n" + prose(34, 100)), (35, (prose(35, 20) + " ") * 40), (36, prose(36, 60)), (37, "\n".join(["x y z"] * 100)),
]


def test_counts_equal_brute_force(spark, tmp_path):
    folder = store(spark, tmp_path, "documents", with_clashes(table(spark, QUALITY)))
    found = quality.op8_compression_quality(spark, folder).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == Counter((i, *base(t)) for i, t in QUALITY)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.band_failed)


def test_base_rules_equal_their_sql_on_odd_texts(spark, tmp_path):
    folder = store(spark, tmp_path, "documents", table(spark, QUALITY))
    with duckdb.connect() as duck:
        duck.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        same_rows(quality.quality_base_rules(spark, folder), duck, sql.quality_base())


def test_bands_reject_repetition_and_noise(spark):
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randrange(0x21, 0x7F)) for _ in range(40)) for _ in range(500))
    half = prose(7, 400) + " " + " ".join(prose(8, 7).split()[k % 7] for k in range(3000))
    rows = [(1, prose(1, 400)), (2, noise), (3, "ab " * 4000), (4, prose(2, 60)), (5, half)]
    got = {x.doc_id: x.band_failed for x in quality.measure(table(spark, rows)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True}
    docs = with_clashes(table(spark, rows))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 4]
    assert kept.where("doc_id = 1").first().text == prose(1, 400)


def noise(kind, n, seed):
    """n bytes of random characters: lines of 20, or words of 2 to 10."""
    r = random.Random(f"{kind} {n} {seed}")
    small, digits = string.ascii_lowercase, string.digits
    alphabet = {"base64": string.ascii_letters + digits + "+/", "alnum": string.ascii_letters + digits, "both cases": string.ascii_letters,
                "small alnum": small + digits, "small": small, "hex": digits + "abcdef"}[kind]
    if kind in ("base64", "hex"):
        return "\n".join("".join(r.choices(alphabet, k=20)) for _ in range(n // 20 + 1))[:n]
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 10))) for _ in range(n // 3 + 1))[:n]


def test_noise_of_several_alphabets_fails_in_every_band(spark):
    starts = [b[0] for b in quality.BANDS]
    lengths = sorted({*starts, *(s - 1 for s in starts[1:]), 200_000})
    since = {"base64": 256, "alnum": 256, "both cases": 768, "small alnum": 1536, "small": 2048, "hex": 8192}
    cases = [(kind, n, seed) for kind, least in since.items() for n in lengths if n >= least for seed in range(5)]
    rows = [(i, noise(*case)) for i, case in enumerate(cases)]
    found = quality.measure(table(spark, rows)).where("not band_failed").collect()
    assert [(cases[r.doc_id], r.ratio) for r in found] == []


def test_clean_documents_stay_inside_the_bands(spark):
    clean = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(clean, "doc_id")
    found = quality.measure(docs).where("not base_failed")
    assert found.count() > 0 and found.where("band_failed").count() == 0


def thue_morse(n, a="a", b="b", sep=""):
    one, two = [a], [b]
    for _ in range(n):
        one, two = one + two, two + one
    return sep.join(one), sep.join(two)


def test_patterns_of_words_and_letters_do_not_collide(library):
    rows = [t for n in (3, 6, 10, 11, 12) for t in thue_morse(n)] + ["x" * n for n in range(1, 200)] + ["\0" * n for n in range(1, 80)]
    words = Words(pa.array(rows), lower=False)
    assert len(set(words.hash.tolist())) == len(rows)
    coder = bpe.Encoder(bpe.vocabulary_path())
    ids, bounds = coder.encode_batch(pa.array(rows))
    for i, text in enumerate(rows):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    pair = thue_morse(8, "ab", "cd", " ")
    for k in (3, 5):
        hashes, bounds = Words(pa.array(pair), lower=False).windows(k)
        runs = [tuple(t.split()[i : i + k]) for t in pair for i in range(256 - k + 1)]
        assert len(set(hashes.tolist())) == len(set(runs)) and bounds[-1] == len(runs)


def test_equal_hashes_of_different_runs_keep_their_own_ids(library, monkeypatch):
    """Every run has one of three hashes: ids come from the bytes all the same."""
    from ambler.llm import textblock

    monkeypatch.setattr(textblock, "word_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    coder = bpe.Encoder(bpe.vocabulary_path())
    for part in (texts()[:30], [prose(1, 40), prose(2, 40), "y" * 100 + " " + "z" * 100], [prose(2, 40)]):
        ids, bounds = coder.encode_batch(pa.array(part))
        for i, text in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_hashes_see_whole_words():
    words = Words(pa.array(["a bc\tabc\n", None, "ABC a", "é", ""]), lower=True)
    assert words.counts.tolist() == [3, 0, 2, 1, 0]
    assert words.hash[2] == words.hash[3] and words.hash[0] == words.hash[4] and len(set(words.hash.tolist())) == 4
    hashes, bounds = words.shingles(5)
    assert np.diff(bounds).tolist() == [1, 0, 1, 1, 0] and len(set(hashes.tolist())) == 3


# --- language


def plain_grams(text):
    """The grams of a text, letter by letter."""
    held = " "
    for c in text.lower():
        if c.isalpha():
            held += c
        elif held[-1] != " ":
            held += " "
    held += "" if held[-1] == " " else " "
    grams = [held[i : i + langid.N] for i in range(len(held) - langid.N + 1)]
    return [g for g in grams if g.strip(" ")]


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by % 2**64
    return x ^ x >> 31


def gram_hash(gram):
    total = 0
    for c in gram:
        total = (total * 0x100000001B3 + ord(c)) % 2**64
    return mixed(total)


def test_grams_equal_plain_python_wherever_a_text_stands():
    rows = ["", "x", "Ab", "abc", "abc.", "..abc..de", "a\0b", "½ ² x", "Ünï 12 ИЯ", "İz", "日本語テ", " \n", *[t for t in texts()[:60]], prose(3, 30)]
    hashes, bounds = langid._grams(rows)
    for i, text in enumerate(rows):
        expected = [gram_hash(g) for g in plain_grams(text.replace("\0", " "))]
        assert hashes[bounds[i] : bounds[i + 1]].tolist() == expected, repr(text)
        assert langid._grams([text])[0].tolist() == expected


def test_the_commonest_languages_are_learned(spark):
    labelled = [(100 * k + i, language(k, i, 20), f"l{k}") for k in range(4) for i in range(5 + k)]
    assert langid.train(table(spark, labelled), most_langs=2).langs == ["l2", "l3"]


def language(k, i, n):
    r = random.Random(1000 * k + i)
    alphabets = ("etaoinshrdlu", "йцукенгшщзхъ", "αβγδεζηθικλμ", "aeiouüößäkmn")
    return " ".join("".join(r.choice(alphabets[k][(w * 3) % 6 :]) for _ in range(r.randint(2, 7))) for w in range(n))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.op5_bitmask_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_documents_and_many_languages(spark):
    labelled = [(4 * i + k, language(k, i, 60), f"l{k}") for k in range(4) for i in range(30)]
    model = langid.train(table(spark, [*labelled, (999, None, "l0"), (998, "text", None)]))
    assert model.langs == ["l0", "l1", "l2", "l3"]
    rows = [(k, language(k, 77, 30)) for k in range(4)] + [(10, None), (11, ""), (12, "12 !? \n"), (16, "½"), (17, "² ① ٣"), (13, "日本"), (14, "x"), (14, "x"), (None, language(1, 5, 9)), (15, language(2, 9, 40_000))]
    docs = with_clashes(table(spark, rows))
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert [by_id[k] for k in range(4)] == ["l0", "l1", "l2", "l3"] and by_id[15] == "l2" and by_id[None] == "l1"
    assert {by_id[i] for i in (10, 11, 12, 16, 17)} == {"und"} and by_id[13] in model.langs
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 15, None}
    assert not {r.doc_id for r in kept.collect()} & {10, 11, 12, 13, 16, 17}


def test_without_labels_everything_is_undetermined(spark):
    model = langid.train(table(spark, [(1, "some text", None)]))
    assert [r.lang_pred for r in langid.predict(table(spark, [(1, "some text")]), model).collect()] == ["und"]


def test_more_languages_than_bits_in_a_word():
    grams = {f"l{i:03}": np.random.default_rng(i).integers(0, 2**63, 200).astype(np.uint64) for i in range(130)}
    model = langid.build(sorted(grams), grams)
    for i in (0, 63, 64, 129):
        hits = model.hits(grams[f"l{i:03}"], np.array([0, 200]))
        assert hits[0].argmax() == i and hits[0, i] > 199.99 and np.sort(hits[0])[-2] < 20


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    crowded = rng.integers(0, 2**63, 400_000).astype(np.uint64)
    model = langid.build(["big", "small"], {"big": crowded, "small": crowded[:100]})
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    hits = model.hits(other, np.array([0, 5000]))
    assert model.wrong[0] > 0.5 and hits[0, 0] < 500


def test_language_passes_hold_little_beside_the_heap():
    """Counting and judging a batch of short texts takes a few slices' arrays, not the batch's."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from ambler.llm import langid

    langid._letters()
    texts = ["the quick brown fox jumps over the lazy dog " * 20] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * len(texts))], ["text", "lang"])
    model = SimpleNamespace(value=langid.build(["de", "en"], {"de": np.arange(9, dtype=np.uint64), "en": langid._grams(texts[:1])[0]}))
    for run in (langid._count, langid._predict(model)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 40 << 20
