"""The operators that SQL can express, beside their SQL on awkward rows; and what they mean, by example."""

import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, oracles, queries, url_reputation
from feedloom.llm.chat import assemble, preference_turns
from tests.conftest import plan_of

CONVERSATIONS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string, host string, verdict string"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(r) for r in frame.where(frame.notna(), None).values.tolist()), key=repr)


def beside_sql(spark, tmp_path, tables, run, sql):
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ours = run(spark, str(tmp_path)).toPandas()
    theirs = con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    return ours


def conversation(spark):
    said = []
    for c in range(12):
        said += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for t in range(c)]
    said += [(20, 0, "system", "s"), (20, 1, "assistant", "same"), (20, 2, "assistant", "same"), (20, 3, "user", "bye"),
             (21, 0, None, "q"), (21, 1, "assistant", None), (21, 1, "assistant", "z"), (21, 5, "assistant", "<|user|> é"),
             (21, 5, "assistant", "<|user|> é"), (None, 1, "assistant", "x"), (22, None, "assistant", "x"),
             (23, 0, "weird <|role", "a"), (23, 1, "assistant", ""), (23, 2, "assistant", "b" * 50_000)]
    return spark.createDataFrame(said, CONVERSATIONS)


def test_chat_beside_sql(spark, tmp_path):
    found = beside_sql(spark, tmp_path, {"conversations": conversation(spark)}, queries.op9_chat_formatting, oracles.OP9)
    assert {2, 20, 21, 23} <= set(found.pair_id) and not {0, 1, 22} & set(found.pair_id)  # these have no reply
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert preference_turns(*chat.pairs_from_replies(empty)).collect() == []


def plain_pair(conv, turns):
    """The two sides of one conversation of unrepeated turns [(turn, role, text)], in plain Python."""
    turns = sorted(turns)
    drawn = {t: hashlib.md5(f"{conv}:{t}".encode()).hexdigest() for t, role, _ in turns if role == "assistant"}
    if not drawn:
        return None
    fork = min(drawn, key=lambda t: (drawn[t], t))
    before, after = [t for t in turns if t[0] < fork], [t for t in turns if t[0] > fork]
    own = [text for _, role, text in before if role == "assistant"]
    again = own[-1] if own else before[-1][2] if before else ""
    good, bad = [t for t in turns if t[0] <= fork], [*before, (fork, "assistant", again)]
    return (good + after, bad) if drawn[fork] < "8" else (good, bad + after)


def test_pairs_fork_at_any_reply_and_lose_no_turn(spark):
    data = [(c, t, ("user", "assistant", "tool")[(t * t + c) % 3 if c % 4 else (t + 1) % 2], f"says {c} {t % 3}")
            for c in range(60) for t in range(c % 9)]
    sides = chat.pairs_from_replies(spark.createDataFrame([(*r, "e", "f") for r in data], CONVERSATIONS + ", part string, fork string"))
    found = [{}, {}]
    for side, rows_of in zip(found, sides, strict=True):
        for r in rows_of.collect():
            side.setdefault(r.pair_id, []).append((r.turn, r.role, r.text))
    plain = {c: plain_pair(c, [r[1:] for r in data if r[0] == c]) for c in range(60)}
    plain = {c: p for c, p in plain.items() if p}
    assert [{c: sorted(t) for c, t in side.items()} for side in found] == [{c: p[k] for c, p in plain.items()} for k in (0, 1)]
    pairs = {r.pair_id: r for r in assemble(preference_turns(*sides)).collect()}
    assert set(pairs) == set(plain)
    lengths = [len(good) - len(bad) for good, bad in plain.values()]
    assert min(lengths) < 0 < max(lengths)  # either side may be the longer
    assert len({len(p.prompt) for p in pairs.values()}) > 5
    # every text of a conversation is in its pair
    assert all(f"says {c} {t % 3}" in p.prompt + p.chosen + p.rejected for c, p in pairs.items() for t in range(c % 9))


def test_prompt_is_the_longest_common_prefix(spark):
    schema = "pair_id long, turn long, role string, text string, part string, fork string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "why"), (1, 3, "assistant", "good")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "why"), (1, 3, "assistant", "bad"),
                (1, 4, "user", "why"), (2, 0, "user", "only here")]
    make = lambda data: spark.createDataFrame([(*r, "x", "y") for r in data], schema)
    turns = preference_turns(make(chosen), make(rejected))
    one = {r.pair_id: r for r in assemble(turns).collect()}
    assert one[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nwhy<|end|>\n"
    assert one[1].chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one[1].chosen[m.start:m.end] for m in one[1].chosen_masks] == ["good<|end|>\n"]
    assert [one[1].rejected[m.start:m.end] for m in one[1].rejected_masks] == ["bad<|end|>\n"]
    assert (one[2].prompt, one[2].chosen, one[2].rejected) == ("", "", "<|user|>\nonly here<|end|>\n")


def test_chat_runs_no_python(spark):
    plan = plan_of(queries.op9_chat_formatting(spark, "/root/testdata/sf0.001"))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


URLS = [None, "", "no scheme", "http://", "HTTP://A.B.Example.NET/en/x?q#f", "https://example.net/en/", "x://net", "x://net/",
        "x://sub.net/a", "x://notexample.com/de/1", "x://example.com/de/", "x://example.com/de", "x://w.org/fr/2",
        "x://w.org/FR/2", "x://user@h.com:80/p?a=://b/", "x://h?q", "x://h#f/x", "a://b://c/d", "x://É.Com/ü?x",
        "x://line\nfeed.com/a\nb", "x://a.co.uk/", "x://www.b.co.uk:8080/", "x://co.uk/", "x://10.0.0.1:80/", "x://[::1]:80/",
        "x://:80/", "x://h.com./", "x://a@b@h.com:1\n/", "x://spam.example.com/1", "x://spam.example.com/2", "x://good.example.com/1"]


def test_urls_beside_sql(spark, tmp_path):
    pages = [(k, u, None, "h", "v") for k, u in enumerate(URLS)] + [(None, "x://spam.example.com/3", None, "h", "v")]
    pages += [(100 + k, f"http://{'bad' if k % 3 else 'ok'}{k % 7}.site.{'com' if k % 2 else 'info'}/{k}", "", "", "")
              for k in range(200)] + [(100, "http://bad1.site.com/again", "", "", "")] * 2
    labels = [(100 + k, 0 if k % 3 else 1, 0) for k in range(0, 200, 2)] + [(101, None, 1), (None, 0, 0), (102, 1, 1),
                                                                          (20, 0, 0), (21, 0, 1), (22, 1, 0)]
    pages += [(400 + k, f"http://w{k}.{'bad' if k % 2 else 'fine'}{k % 3}.co.uk:80/{k}", "", "", "") for k in range(60)]
    labels += [(400 + k, 1 - k % 2, 0) for k in range(60)]
    tables = {"pages": spark.createDataFrame(pages, PAGES),
              "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    found = beside_sql(spark, tmp_path, tables, queries.op10_url_filter, oracles.OP10).set_index("page_id")
    assert set(found.verdict) == {"allow", "block"}
    labelled = found[found.host.str.endswith("site.info")]
    assert ((labelled.verdict == "block") == labelled.host.str.startswith("bad")).all()
    at = {u: found.loc[k] for k, u in enumerate(URLS)}
    assert tuple(at["HTTP://A.B.Example.NET/en/x?q#f"][["host", "path", "rule", "verdict"]]) == (
        "a.b.example.net", "/en/x", "example.net/en/", "allow")
    assert (at["x://sub.net/a"].rule, at["x://net"].rule, at["x://example.com/de"].rule) == ("net/", None, None)
    assert at["a://b://c/d"][["host", "path"]].tolist() == ["b:", "//c/d"]
    assert at["x://notexample.com/de/1"].rule is None or pd.isna(at["x://notexample.com/de/1"].rule)


def test_registered_domains(spark):
    hosts = {"a.co.uk": ("a.co.uk", "co.uk"), "www.b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "x.y.example.com": ("example.com", "com"), "u:p@h.org:80": ("h.org", "org"), "h.org.": ("h.org", "org"),
             "10.0.0.1:80": ("10.0.0.1", ""), "[::1]:80": ("[::1]", ""), "localhost": ("localhost", "localhost"),
             "a.notco.uk": ("notco.uk", "uk"), "": ("", "")}
    domain = url_reputation.domain_of(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select(
        "host", domain.alias("domain"), url_reputation.suffix_of(domain).alias("suffix")).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == hosts
    city = url_reputation.domain_of(F.lit("a.b.city.kobe.jp"), ["kobe.jp", "city.kobe.jp"])  # the longest suffix counts
    assert spark.range(1).select(city.alias("d")).first().d == "b.city.kobe.jp"


def test_one_suffix_of_two_labels_is_no_domain(spark):
    pages = [(k, f"http://{'bad' if k < 50 else 'fine'}.co.uk/{k}") for k in range(100)] + [(200, "http://new.fine.co.uk/")]
    outcomes = [(k, int(k < 50)) for k in range(100)]
    found = {r.page_id: r for r in url_reputation.judge(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert found[0].verdict == "block" and found[99].verdict == found[200].verdict == "allow"


@pytest.mark.parametrize("labels", [[], [(1, 0, 1)]])
def test_urls_without_tables(spark, tmp_path, labels):
    pages = [] if labels else [(1, "x://a.b/c", "", "", "")]
    tables = {"pages": spark.createDataFrame(pages, PAGES),
              "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    found = beside_sql(spark, tmp_path, tables, queries.op10_url_filter, oracles.OP10)
    assert found.verdict.tolist() == ["allow"] * len(pages)


def test_few_labels_are_shrunk(spark):
    pages = spark.createDataFrame([(k, f"x://h{k}.example.com/a") for k in range(40)] + [(99, "x://h1.example.com/b")],
                                  "page_id long, url string")
    outcomes = spark.createDataFrame([(k, int(k == 1)) for k in range(39)], "page_id long, bad int")
    found = {r.page_id: r for r in url_reputation.judge(pages, outcomes).collect()}
    assert found[1].verdict == found[99].verdict == "allow"  # one bad page does not condemn a host
    assert found[1].bad_bound > found[2].bad_bound
    assert url_reputation.judge(pages.limit(0), outcomes).select(F.count("*")).first()[0] == 0
