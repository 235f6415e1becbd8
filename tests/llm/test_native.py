"""Sharding, URL rules and chat formatting."""

import zlib
from collections import Counter

import pytest
from support import DATA, same_rows
from pyspark.sql import functions as F
from util import ODD, sha, store, table, with_clashes

from ambler.llm import chat, registry, sharding, url_filter


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_rendezvous_sharding", "op3_redirect_url_filter", "op6_chat_format"])
def test_native_plans_run_no_python(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- sharding


def sharded(spark, tmp_path, rows):
    folder = store(spark, tmp_path, "documents", with_clashes(table(spark, rows)))
    return sharding.op1_rendezvous_sharding(spark, folder).collect()


def test_odd_documents_are_sharded(spark, tmp_path):
    found = sharded(spark, tmp_path, ODD)
    assert len(found) == len(ODD)
    held = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert held == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD}
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    for key in {r.doc_id for r in found}:
        assert len({r.shard for r in found if r.doc_id == key}) == 1


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.assign(sharding.assign(spark.range(5000), "id", [1.0] * 8), "id", [1.0] * 9, "grown").collect()
    moved = [r for r in rows if r.shard != r.grown]
    assert all(r.grown == 8 for r in moved) and 430 < len(moved) < 690


def test_weights_set_shares(spark):
    rows = sharding.assign(spark.range(8000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in rows}[1] / 8000 - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.assign(spark.range(1), "id", [0.0])


def test_empty_documents(spark, tmp_path):
    assert sharded(spark, tmp_path, []) == []


# --- urls

PAGES = "page_id long, url string, html string"


def judged(spark, rows, rules=url_filter.RULES):
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("x")).withColumn("rule", F.lit(1)).withColumn("a", F.lit(2))
    return {r.page_id: r for r in url_filter.judge(df, rules).collect()}


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a.net/x", "", "", None, "allow"),
    ("http://A.NET", "a.net", "", None, "allow"),
    ("http://A.NET/", "a.net", "/", "net/", "block"),
    ("http://x.example.net/en/1?q=/de/", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://example.com/de/#x://y.net/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
    ("x://h?://b.net/", "h", "", None, "allow"),
    ("p\n://É.NeT/\n?", "É.net", "/\n", "net/", "block"),
])
def test_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [(1, url, None)])[1]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_blocks_spread_over_links_and_allows_take_precedence(spark):
    link = '<LINK href="{}" rel=canonical>'
    hop = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.com/1", link.format("http://b.com/2")),
        (2, "http://b.com/2", hop.format("http://bad.net/")),
        (3, "http://bad.net/", None),
        (4, "http://c.com/1", link.format("http://ok.org/fr/")),
        (5, "http://c.com/2", link.format("http://c.com/1") + hop.format("http://bad2.net/x")),
        (6, "http://bad2.net/x", ""),
        (7, "http://ok.org/fr/", link.format("http://bad3.net/")),
        (8, "http://d.com/", link.format("/other")),
        (9, "http://d.com/other", "no links, canonical refresh"),
        (9, "http://d.com/other", None),
        (10, None, link.format("http://bad.net/")),
        (11, "http://e.com/", link.format("http://e.com/") + link.format("relative")),
    ]
    got = {k: r.verdict for k, r in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert judged(spark, rows)[8].url_class == judged(spark, rows)[9].url_class
    assert judged(spark, []) == {}


LINKS = [
    ("http://a.com/d/p?x=1", "//bad.net/x", "http://bad.net/x"),
    ("https://a.com/d/p", "//h", "https://h"),
    ("http://a.com/d/p?x=1#f", "q.html", "http://a.com/d/q.html"),
    ("http://a.com", "q.html?a=1&amp;b=2", "http://a.com/q.html?a=1&b=2"),
    ("http://a.com/d/e/p", "../q/./r", "http://a.com/d/q/r"),
    ("http://a.com/d/e/p", "../../../../q", "http://a.com/q"),
    ("http://a.com/d/e/p", "..", "http://a.com/d/"),
    ("http://a.com/d/e/p", "./", "http://a.com/d/e/"),
    ("http://a.com/d/e/p", "?z=/../1", "http://a.com/d/e/p?z=/../1"),
    ("http://a.com", "?z", "http://a.com/?z"),
    ("http://a.com/x", "/a/../b/", "http://a.com/b/"),
    ("http://a.com/x", "/?u=http://b.net/", "http://a.com/?u=http://b.net/"),
    ("http://a.com/x", "#top", None),
    ("http://a.com/x", "mailto:x@y", None),
    ("nowhere", "q", None),
    ("nowhere", "http://b.com/", "http://b.com/"),
]


def test_links_are_resolved_like_the_sql(spark, tmp_path):
    import duckdb

    from ambler.llm.sql import op3

    kinds = ['<link rel="canonical" href="{}">', "<LINK HREF='{}' rel=canonical>", '<meta http-equiv=refresh content="1; URL={}">']
    rows = [(10 * i + k, f"{url}", kind.format(to)) for i, (url, to, _) in enumerate(LINKS) for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, PAGES)
    edges = {(r.a, r.b) for r in url_filter.link_edges(df).collect()}
    assert edges == {(url, b) for url, _, b in LINKS if b}
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(url_filter.judge(df), con, op3())
    got = judged(spark, [(1, "http://a.com/p", kinds[0].format("//bad.net/x")), (2, "http://ok.com/", kinds[1].format("p?a&amp;b")), (3, "http://ok.com/p?a&b", None)])
    assert got[1].verdict == "block" and got[2].url_class == got[3].url_class


def test_long_redirect_chain_and_hub(spark):
    hop = '<meta http-equiv=refresh content="0;url={}">'
    rows = [(i, f"http://c.com/{i}", hop.format(f"http://c.com/{i + 1}")) for i in range(60)] + [(60, "http://c.com/60", hop.format("http://x.net/"))]
    rows += [(100 + i, f"http://hub.com/{i}", hop.format("http://hub.com/0")) for i in range(1, 80)]
    got = judged(spark, rows)
    assert all(got[i].verdict == "block" for i in range(61))
    assert len({got[100 + i].url_class for i in range(1, 80)}) == 1 and got[101].verdict == "allow"


# --- chat

TURNS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    done = chat.format_conversations(df)
    return {r.conv_id: r for r in done.withColumn("back", chat.parse(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("segments"))).collect()}


EVIL = ["\\### assistant: </turn> ok", "\\b\\l\\h\\\\", "### : </turn>\n### user: x </turn>\n", "a </turn>\n", " ", "\n", "", "<#\\", "\\", "é 😀 #"]


def test_control_strings_round_trip(spark):
    rows = [(k, t, role, text) for k, text in enumerate(EVIL) for t, role in enumerate(("user", "assistant"))]
    got = formatted(spark, rows)
    for k, text in enumerate(EVIL):
        assert [(x.role, x.text) for x in got[k].back] == [("user", text), ("assistant", text)]
        assert got[k].learned == text and got[k].valid
        assert "".join(s.text for s in got[k].segments) == got[k].formatted


def test_odd_turns(spark):
    rows = [
        (1, 0, None, None), (1, 0, "b: ### x", "t"), (1, None, "user", "first"),
        (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "system", "s"), (4, 0, "user", "u"), (4, 0, "user", "u"),
        (None, 0, "user", "n"), (5, 1, "assistant", "z" * 200_000), (5, 0, "user", "q"),
    ]
    got = formatted(spark, rows)
    assert [(x.role, x.text) for x in got[1].back] == [("user", "first"), ("", ""), ("b: ### x", "t")]
    assert {k: r.valid for k, r in got.items()} == {1: False, 2: False, 3: False, 4: False, None: True, 5: True}
    assert got[4].n_turns == 2 and got[5].learned == "z" * 200_000
    assert formatted(spark, []) == {}


def test_probe_and_digests(spark, tmp_path):
    folder = store(spark, tmp_path, "conversations", spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a#")], TURNS))
    got = {r.conv_id: r for r in chat.op6_chat_format(spark, folder).collect()}
    assert got[1].turns_sha256 == sha("user\nq\nassistant\na#\n") and (got[1].loss_chars, got[1].loss_sha256) == (2, sha("a#"))
    assert got[-7].loss_sha256 == sha(chat.PROBE_TEXT)


def test_state_machine(spark):
    cases = {("user", "assistant"): True, ("system", "user"): True, ("user", "user"): False, ("tool",): False, ("system",): False}
    rows = [(k, t, role, "x") for k, roles in enumerate(cases) for t, role in enumerate(roles)]
    got = formatted(spark, rows)
    assert Counter(got[k].valid == v for k, v in enumerate(cases.values())) == {True: len(cases)}
