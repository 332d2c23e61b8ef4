"""Operators that judge each row by itself, packing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import catalogue, chat_format, html_text, langid, packing, quality, token_counts, url_filter
from tests.oracle import connect, same

EMPTY = "doc_id long, text string"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name])


# op1
def test_urls(spark):
    rows = ["https://EXAMPLE.org/es/x", "http://a.b.example.org/en/1?q", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/de/", "http://x.com", None, "", "no scheme", "http://", "a://b://c", "http://org#x", "http://org/", "http://x.com/fr/" + "y" * 5000, "http://ÄB.org/x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(0, rows[0], "h")], "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.url_filter(df).orderBy("page_id").collect()]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in url_filter.RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        return host, path, best and best.key, best.verdict if best else "allow"

    assert got == sorted([(i, *judge(u)) for i, u in enumerate(rows)] + [(0, *judge(rows[0]))], key=lambda x: x[0])
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_cascade_is_exact_with_poor_filters(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 400, 4)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(400)], "key string")
    c = url_filter.build_cascade(listed, universe, fpp=0.4, later_fpp=0.5)
    assert len(c.levels) > 2
    assert {r["key"] for r in universe.where(c.has(F.col("key"))).collect()} == {f"k{i}" for i in range(0, 400, 4)}


def test_equal_rules_and_long_urls(spark):
    rules = (url_filter.Rule("block", "a.com"), url_filter.Rule("allow", "a.com"), url_filter.Rule("block", "com", "/x/"), url_filter.Rule("allow", "b.com", "/x/"))
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://c.com/x/y"), (3, "http://b.com/x/" + "z" * 1_000_000), (4, "http://" + "s." * 2000 + "b.com/x/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules, default="none").collect()}
    assert got == {1: ("a.com/", "allow"), 2: ("com/x/", "block"), 3: ("b.com/x/", "allow"), 4: ("b.com/x/", "allow")}


# op2
def brute_repeats(ids):
    n = len(ids)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ids[i + k] == ids[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return [b if b >= 3 else 0 for b in best]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(ids):
    assert quality.longest_repeats(np.array(ids, np.int64)).tolist() == brute_repeats(ids)


def test_longest_repeats_of_many_words():
    ids = np.array([0, 1, 2, 3, 1 << 40, 0, 1, 2, 3], np.int64)
    assert quality.longest_repeats(ids).tolist() == brute_repeats(ids.tolist())


def test_quality_edges(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, words), (4, words + " " + words), (5, "a " * 20000), (6, words + "\n\n \n" + "x" * 100000), (7, "a\u00a0b c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in [*rows, rows[2]]], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    assert quality.quality_report(df).count() == 8
    assert not got[1]["kept"] and not got[2]["kept"] and got[3]["kept"] and not got[4]["kept"] and not got[5]["kept"] and got[6]["kept"]
    assert got[7]["n_words"] == 2 and got[4]["longest_repeat"] == 60 and got[4]["n_repeat_words"] == 120
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 3, 6]
    assert quality.quality_report(df.limit(0)).count() == 0


# op4
def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 20 and got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_code_lengths_equal_plain_counting():
    texts = {"a": [b"abracadabra abra", b"bad"], "b": [b"zzz yyy xyz"]}
    model = langid.Model(texts, 2)

    def plain(lang, data):
        tree = {}
        for t in texts[lang]:
            t = b"\0\0" + t
            for i in range(2, len(t)):
                for k in range(3):
                    node = tree.setdefault(t[i - k : i], {})
                    node[t[i]] = node.get(t[i], 0) + 1
        total, data = 0.0, b"\0\0" + data
        for i in range(2, len(data)):
            for k in (2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                node = tree.get(data[i - k : i])
                if node is None:
                    continue
                n = sum(node.values()) + len(node)
                if data[i] in node:
                    total -= np.log2(node[data[i]] / n)
                    break
                total -= np.log2(len(node) / n)
        return total

    for data in (b"abra", b"xyz bad", b"\xc3\xa4", b"q", b"abracadabra" * 30):
        assert model.lengths([data])[0] == pytest.approx([plain("a", data), plain("b", data)], rel=1e-5)
    long = b"abra yyy " * 60000
    assert model.lengths([long, b"", long[:100]])[0] == pytest.approx(model.bits(long).sum(axis=0, dtype=float), rel=1e-6)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [(i, "der hund und die katze " * 5, "de") for i in range(40, 80)] + [(90, None, "en"), (91, "", "en"), (92, "12 !?", "de"), (93, "the dog", None), (94, "the dog " * 50000, None)]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    assert [got[i]["lang_pred"] for i in (90, 91, 92, 93, 94, 50)] == ["und", "und", "und", "en", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[92]["score"] == 0
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def test_ties_and_empty_tables_of_languages(spark):
    model = langid.Model({"b": [b"same text"], "a": [b"same text"]}, 3)
    assert model.predict(["same text", "other"])[0] == ["a", "a"] and model.predict(["same text"])[1][0] == pytest.approx(0.5)
    assert langid.predict(spark.createDataFrame([], EMPTY), model).count() == 0


# op5
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "Straße", "of", "𝔘nicode", "x"]) for _ in range(r.choice([0, 1, 50, 3000])))) for i in range(60)] + [(70, None), (71, ""), (72, "a <|endoftext|> b"), (73, "z" * 40000)]
    df = spark.createDataFrame([*rows, rows[3]], EMPTY).withColumn("offset", F.lit(1))
    got = packing.pack(df, packing.PackParams(group_docs=25)).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == i].drop_duplicates("start").sort_values("start")
        assert own["start"].tolist() == [0, *np.cumsum(own["length"]).tolist()[:-1]] and own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"]).tolist()[:-1]] and s["length"].sum() <= 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_long_runs(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    texts = [" " * 2_000_000 + "a", "\n" * 2_000_000 + "a", "ab" * 1_000_000]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), EMPTY)).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"] == i].sort_values("start")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist() and own["length"].sum() == len(ids)


def test_null_and_repeated_ids_spread_over_groups(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(5, "same")] * 300, EMPTY)
    got = packing.pack(df, packing.PackParams(group_docs=50)).select((F.col("sequence_id") / (1 << 32)).cast("long").alias("g"), "doc_id").groupBy("g", "doc_id").count().toPandas()
    assert got["count"].sum() == 600 and got.groupby("doc_id", dropna=False)["count"].max().max() <= 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 20)
    free, want = [], []
    for s in sizes:
        b = next((i for i, f in enumerate(free) if f >= s), len(free))
        free += [20] * (b == len(free))
        want.append((b, 20 - free[b]))
        free[b] -= s
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


# op6
def test_preferences(spark):
    rows = [(1, s, 0, "user", "hi") for s in ("chosen", "rejected")] + [(1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 1, "assistant", "no"), (2, "chosen", 0, None, None), (3, "rejected", 0, "assistant", "só"), (None, "chosen", 0, "user", "x")]
    got = {r["pair_id"]: r for r in chat_format.preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3} and got[1]["n_prompt_turns"] == 1 and got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    for side, word in (("chosen", "yes"), ("rejected", "no")):
        (m,) = got[1][f"{side}_mask"]
        assert got[1][side][m["start"] : m["start"] + m["length"]] == word + "<|im_end|>\n"
    assert got[2]["rejected"] == "" and got[3]["chosen"] == "" and got[3]["n_prompt_turns"] == 0


def test_alternatives_share_a_prompt(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "more"), (1, 3, "assistant", "second"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "none"), (4, 0, "assistant", None), (4, 0, "assistant", "b"), (6, 0, "assistant", None), (6, 1, "assistant", "b"), (6, 2, "assistant", ""), (6, 3, "assistant", None), (7, 0, "assistant", "same"), (7, 1, "assistant", "same"), (None, 0, "assistant", "x"), (5, None, "assistant", "x")]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string").withColumn("side", F.lit(1)).withColumn("pair_id", F.lit(1))
    got = {r["pair_id"]: r for r in chat_format.preference_pairs(chat_format.alternatives(df)).collect()}
    assert set(got) == {1, 6} and all(r["chosen"] and r["rejected"] for r in got.values())
    assert got[1]["n_prompt_turns"] == 3 and "bye" not in got[1]["chosen"] and "second" in got[1]["chosen"] and "first" in got[1]["rejected"] and "first" in got[1]["prompt"]
    assert got[6]["n_prompt_turns"] == 3 and "b" in got[6]["rejected"] and got[6]["chosen"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert chat_format.preference_pairs(chat_format.alternatives(df.limit(0))).count() == 0


def test_masks_of_a_long_conversation(spark):
    n = 3000
    rows = [(1, s, i, "assistant" if i % 2 else "user", f"turn {i}" if i < n - 1 else s) for s in ("chosen", "rejected") for i in range(n)]
    r = chat_format.preference_pairs(spark.createDataFrame(rows + [(2, "chosen", 0, "assistant", "y" * 1_000_000)], "pair_id long, side string, turn long, role string, text string")).orderBy("pair_id").collect()
    assert r[0]["n_prompt_turns"] == n - 1 and r[0]["chosen"].count("<|im_start|>") == 1
    assert [tuple(m) for m in r[1]["chosen_mask"]] == [(len("<|im_start|>assistant") + 1, 1_000_000 + len("<|im_end|>\n"))]


# op7
def page(body, host="a.com", i=0):
    return (i, f"http://{host}/{i}", body)


def test_html(spark):
    body = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header>H</header><nav><ul><li><a href='/x'>Menu</a></ul></nav><div class=\"ad\">Buy</div><article><h1>Head &amp; line</h1><p>One&nbsp;two<br>three <b>bo</b>ld<p>Four &#252;<form>F<input></form><div id='comments'>C</div></article><aside>S</aside><footer>&copy; F</footer></body></html>"
    rows = [page(body), page(None, i=1), page("", i=2), page("<p>just <i>text", i=3), page("plain &lt; text", i=4), page("<nav>only</nav>", i=5), (6, None, "<p>no url</p>"), page("<p>" + "long " * 50000, i=7), page("<div " * 2000, i=8), page("a < b <!-- c > d", i=9)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("places", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[0] == "Head & line One two three bold Four ü"
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[9]) == ("", "", "just text", "plain < text", "", "no url", "a < b")
    assert len(got[7]) == 5 * 50000 - 1
    assert html_text.main_text(df).count() == 11 and html_text.main_text(df.limit(0)).count() == 0


def test_repeated_branches_of_a_site_go(spark):
    rows = [page(f"<body><div class='x1'><p>Same words on every page</p></div><div class='x2'><p>Own text number {i} of this page</p></div></body>", i=i) for i in range(80)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Own text number {r['page_id']} of this page" for r in got)


# op9
def test_token_counts_equal_plain_dynamic_programming(spark):
    p = token_counts.CountParams()
    pieces, byte, longest = token_counts.vocabulary(p.model, p.shift)

    def plain(word):
        w = token_counts.MARK + word
        best = [(0.0, 0)]
        for j in range(1, len(w) + 1):
            options = [(best[i][0] + pieces[w[i:j]], best[i][1] + 1) for i in range(max(0, j - longest), j) if w[i:j] in pieces]
            if w[j - 1] not in pieces:
                n = len(w[j - 1].encode())
                options.append((best[j - 1][0] + n * byte, best[j - 1][1] + n))
            top = max(s for s, _ in options)
            best.append((top, min(c for s, c in options if s == top)))
        return best[-1][1]

    text = "hello help helping helper Straße 日本語 𝔘 a aa aaa extraordinarily x" + "y" * 500
    rows = [(1, text), (2, None), (3, ""), (4, " \n"), (5, text + " " + text)]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(spark.createDataFrame([*rows, rows[0]], EMPTY).withColumn("n_tokens", F.lit(0))).collect()}
    n = sum(plain(w) for w in text.split())
    assert got == {1: (len(text.split()), n), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (2 * len(text.split()), 2 * n)}
    assert token_counts.token_counts(spark.createDataFrame([], EMPTY)).count() == 0


def test_title_block_of_an_article_stays(spark):
    body = '<div class="topbar">Top</div><div class="story"><div class="story-header"><h1>Title</h1></div><p>Body</p><div class="related-links">R</div></div>'
    got = html_text.main_text(spark.createDataFrame([page(body)], "page_id long, url string, html string")).first()
    assert got["text"] == "Title Body"
